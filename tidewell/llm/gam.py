"""A generalised additive model with pairwise interactions, fitted by cyclic boosting.

Each feature has a lookup table over its bins, and some pairs of features have one over
coarser bins. Boosting goes round the features; each turn fits a tree of at most three leaves
to the logistic loss's gradient over the feature's histogram and adds it, shrunk, to the table. Then
the pairs whose four-cell trees reduce the loss most get the same treatment. Scoring adds up looked-up values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 48
PAIR_BINS = 12
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.15
RIDGE = 1.0


@dataclass
class Gam:
    edges: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        total = np.full(len(x), self.bias)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for (a, b), table in self.pairs.items():
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain of the best cut of a histogram in two, and where the right part begins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of at most three leaves over a histogram."""
    gain, cut = _best_cut(g, h)
    parts = [(0, len(g))] if gain <= 0 else [(0, cut), (cut, len(g))]
    if len(parts) == 2:
        again = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        best = max(again, key=lambda x: x[0])
        if best[0] > 0:
            parts = [p for p in parts if p != best[2:]] + [(best[2], best[2] + best[1]), (best[2] + best[1], best[3])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one feature and then the other: four cells."""
    cum = lambda x: np.cumsum(np.cumsum(x, 0), 1)
    G, H = cum(g), cum(h)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    ll_g, ll_h = G[:-1, :-1], H[:-1, :-1]
    lr_g, lr_h = G[:-1, -1:] - ll_g, H[:-1, -1:] - ll_h
    rl_g, rl_h = G[-1:, :-1] - ll_g, H[-1:, :-1] - ll_h
    rr_g, rr_h = G[-1, -1] - ll_g - lr_g - rl_g, H[-1, -1] - ll_h - lr_h - rl_h
    gain = _gain(ll_g, ll_h) + _gain(lr_g, lr_h) + _gain(rl_g, rl_h) + _gain(rr_g, rr_h) - _gain(G[-1, -1], H[-1, -1])
    i, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for rows, cols, gg, hh in ((slice(0, i + 1), slice(0, k + 1), ll_g, ll_h), (slice(0, i + 1), slice(k + 1, None), lr_g, lr_h), (slice(i + 1, None), slice(0, k + 1), rl_g, rl_h), (slice(i + 1, None), slice(k + 1, None), rr_g, rr_h)):
        out[rows, cols] = gg[i, k] / (hh[i, k] + RIDGE)
    return float(gain[i, k]), out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """x: rows of features, y: labels 0 or 1. Without rows of both labels the score is constant."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    n = x.shape[1]
    model = Gam([_edges(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(n)], float(np.log(rate / (1 - rate))), [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not 0 < y.sum() < len(y):
        return model
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    total = np.full(len(x), model.bias)

    def gradient():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(n):
            g, h = gradient()
            m = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, m), np.bincount(bins[j], h, m))
            model.tables[j] += step
            total += step[bins[j]]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(n)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]

    def histogram(a, b, w):
        ma, mb = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        return np.bincount(coarse[a] * mb + coarse[b], w, ma * mb).reshape(ma, mb)

    g, h = gradient()
    gains = [(_pair_tree(histogram(a, b, g), histogram(a, b, h))[0], a, b) for a in range(n) for b in range(a + 1, n)]
    chosen = [(a, b) for _, a, b in sorted(gains, key=lambda t: (-t[0], t[1:]))[:PAIRS]]
    for a, b in chosen:
        model.pairs[a, b] = np.zeros_like(histogram(a, b, g))
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            g, h = gradient()
            step = RATE * _pair_tree(histogram(a, b, g), histogram(a, b, h))[1]
            model.pairs[a, b] += step
            total += step[coarse[a], coarse[b]]
    return model
