"""Words and rolling hashes of whole Arrow string columns, vectorised over UTF-8 bytes.

The word rules used here are ASCII classes, so they hold byte by byte: every byte of a
multi-byte character is above 0x7F and belongs to a word under each rule.

* ``blank``: runs of bytes other than space and 0x09-0x0D, unchanged;
* ``lower``: the same runs, A-Z lower-cased;
* ``alnum``: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters.

A word's hash is a polynomial over its bytes modulo 2**64, taken as a difference of prefix
sums and then mixed; windows of words are hashed in the same way over word hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1B54A32D192ED03 | 1
#: Bytes, and words, handled at once: small enough for the CPU's cache, whatever the batch size.
CHUNK = 1 << 19
SLICE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(_STEP)) | U(1)
    if fold:
        values[65:91] = values[97:123]
    return values


def _word_bytes(rule: str) -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    if rule in ("blank", "lower"):
        inside[[32, *range(9, 14)]] = False
    else:
        inside[:128] = False
        for a, b in ((48, 58), (65, 91), (97, 123)):
            inside[a:b] = True
    return inside


RULES = {rule: (_word_bytes(rule), _byte_values(rule != "blank")) for rule in ("blank", "lower", "alnum")}


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64; tables of up to `most` are kept, longer ones are made for one use."""

    def __init__(self, base: int, most: int):
        self.bases, self.most = (base, pow(base, -1, 1 << 64)), most
        self.kept = (np.ones(1, dtype=U),) * 2

    @staticmethod
    def _made(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, dtype=U)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.most:
            return tuple(self._made(b, n) for b in self.bases)
        if len(self.kept[0]) < n:
            size = min(self.most, 1 << (n - 1).bit_length())
            self.kept = tuple(self._made(b, size) for b in self.bases)
        return self.kept


_bytes_powers, _words_powers = _Powers(_BASE, 2 * CHUNK), _Powers(_STEP, 2 * SLICE)


@dataclass
class Words:
    """Hashes of all words, the first word of each row (one more entry at the end), and byte spans if asked for."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray | None = None
    end: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to its row's end, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.cast(pa.large_string()).chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(column, most: int = 1 << 21):
    """(first, last) ranges of rows of at most about so many bytes, one row at least."""
    _, offsets = column_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(stop, n)
        at = min(stop, n)


def tokenise(column, rule: str, spans: bool = False) -> Words:
    """The words of every row of a string column."""
    inside, values = RULES[rule]
    data, offsets = column_bytes(column)
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(data):
        stop = min(at + CHUNK, len(data))
        if stop < len(data):  # cut between two words
            k = int(np.searchsorted(offsets, stop, "right")) - 1
            if offsets[k] > at:
                stop = int(offsets[k])
            else:
                while stop < len(data) and stop < offsets[k + 1]:
                    gap = np.flatnonzero(~inside[data[stop : stop + CHUNK]])
                    if len(gap):
                        stop += int(gap[0])
                        break
                    stop = min(stop + CHUNK, len(data))
                stop = min(stop, int(offsets[k + 1]))
        piece = data[at:stop]
        own = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop, "right")] - at
        isin = inside[piece]
        edge = np.zeros(len(piece) + 1, dtype=bool)
        edge[own[(own >= 0) & (own <= len(piece))]] = True
        edge[0] = edge[-1] = True
        before = np.empty_like(isin)
        before[0], before[1:] = False, isin[:-1]
        after = np.empty_like(isin)
        after[-1], after[:-1] = False, isin[1:]
        s = np.flatnonzero(isin & (~before | edge[:-1]))
        e = np.flatnonzero(isin & (~after | edge[1:])) + 1
        up, down = _bytes_powers.get(len(piece))
        total = np.empty(len(piece) + 1, dtype=U)
        total[0] = 0
        np.cumsum(values[piece] * up[: len(piece)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U)))
        starts.append(s + at)
        if spans:
            ends.append(e + at)
        at = max(stop, at + 1)
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else empty
    words = Words(np.concatenate(hashes) if hashes else np.zeros(0, U), np.searchsorted(start, offsets).astype(np.int64))
    if spans:
        words.start, words.end = start, np.concatenate(ends) if ends else empty
    return words


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of the k words from each position on; positions without k words are left out at the end."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, dtype=U)
    for a in range(0, n, SLICE):
        part = hashes[a : a + SLICE + k - 1]
        up, down = _words_powers.get(len(part))
        total = np.empty(len(part) + 1, dtype=U)
        total[0] = 0
        np.cumsum(part * up[: len(part)], out=total[1:])
        m = len(part) - k + 1
        out[a : a + m] = mix((total[k:] - total[:-k]) * down[:m] + U(k))
    return out


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k words of one row begin, and the hashes of these windows."""
    at = np.flatnonzero(words.room() >= k)
    return at, rolling(words.hash, k)[at] if len(at) else np.zeros(0, U)
