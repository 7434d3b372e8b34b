"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Unit vectors are projected to DIMS dimensions by Gaussian directions, the same on every machine. For a
true distance d the squared projected distance over d squared follows a chi-square law with
DIMS degrees of freedom. Each block of rows has a kd-tree over the projections of its distinct vectors; a query takes
the tree's leaves by their distance from its own projection, verifies the vectors in them, and
stops when a vector as near as the k-th best so far would, with probability CONFIDENCE, have been met already.

Every row is in one block's tree; packs of queries stream past every block of rows, so that a task holds one
block and never all queries, and the best of each block are merged. Nearness is the cosine in double precision on the original
vectors (very large or small ones are scaled by a power of two, which is exact); ties go to the smaller id.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part; vectors of
another length than the query's are no candidates; rows that share the query's id are its own; other repeated rows are candidates each; of several
rows with a query's id the smallest vector asks; an empty table gives none; further columns are not used.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean_batches, partitions

DIMS = 8
LEAF = 64
CONFIDENCE = 0.995
SEED = 71
#: Bytes of queries in a row, so that an Arrow batch of ten thousand rows stays small.
PACK = 8192
FOUND = "query_id long, vec_id long, score double"


def _directions(length: int) -> np.ndarray:
    return np.random.default_rng([SEED, length]).standard_normal((length, DIMS))


def chi_square(x: float, dims: int = DIMS) -> float:
    """Distribution function for an even number of degrees of freedom."""
    if x > 1400:
        return 1.0
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, dims // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total


def _quantile(p: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid) < p else (low, mid)
    return high


class Tree:
    """A kd-tree over projected points: rows in leaf order, and the box of each leaf."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.starts: list[int] = []
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= LEAF:
                self.starts.append(a)
                continue
            own = points[self.order[a:b]]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            stack += [(a + mid, b), (a, a + mid)]
        self.starts.sort()
        self.stops = [*self.starts[1:], len(points)]
        ranked = points[self.order]
        self.low = np.minimum.reduceat(ranked, self.starts, axis=0) if len(points) else ranked
        self.high = np.maximum.reduceat(ranked, self.starts, axis=0) if len(points) else ranked

    def leaves(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by squared distance of their boxes from a point."""
        out = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        far = (out * out).sum(1)
        order = np.argsort(far, kind="stable")
        return order, far[order]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose squares would under- or overflow, times a power of two: exact, and no cosine changes."""
    exponent = np.frexp(np.abs(vectors).max(1))[1]
    return np.where((np.abs(exponent) > 300)[:, None], np.ldexp(vectors, -exponent[:, None]), vectors)


class Block:
    """Rows of one block under a kd-tree. ids ascend; equal vectors are one point of the tree with the ids of all."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, confidence: float):
        vectors = np.ascontiguousarray(vectors + 0.0)  # no negative zeros: equal vectors have equal bytes
        _, first, group = np.unique(vectors.view(f"V{vectors.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
        vectors = vectors[first]
        norms = np.sqrt((vectors * vectors).sum(1))
        unit = vectors / norms[:, None]
        self.directions = _directions(vectors.shape[1])
        self.tree = Tree(unit @ self.directions)
        order = self.tree.order
        self.ids, self.vectors, self.unit, self.norms = ids, vectors[order], unit[order], norms[order]
        self.point = np.argsort(order)[group]  # the point of each row
        self.members = ids[np.argsort(self.point, kind="stable")]
        self.count = np.bincount(self.point, minlength=len(vectors))
        self.begin = np.cumsum(self.count) - self.count
        self.k, self.limit = k, _quantile(confidence)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray):
        """The k nearest rows found for each query: (query_id, vec_id, score)."""
        for query_id, q in zip(query_ids, queries, strict=True):
            yield from self._one(query_id, q)

    def _one(self, query_id: int, q: np.ndarray):
        tree, ids, k = self.tree, self.ids, self.k
        own = q / math.sqrt((q * q).sum())
        leaves, far = tree.leaves(own @ self.directions)
        mine = self.point[np.searchsorted(ids, query_id) : np.searchsorted(ids, query_id, "right")]
        best, kth, at, step = [], -np.inf, 0, 2
        # projections of nearly equal vectors differ by rounding, so a bound of 0 needs a tolerance
        while at < len(leaves) and not (len(best) and kth > -np.inf and far[at] > self.limit * max(0.0, 2 - 2 * kth) + 1e-9):
            rows = np.concatenate([np.arange(tree.starts[i], tree.stops[i]) for i in leaves[at : at + step]])
            at, step = at + step, min(step * 2, 16)
            left = self.count[rows]
            for p in mine:
                left = left - (rows == p)
            rows, left = rows[left > 0], np.minimum(left[left > 0], k)
            near = self.unit[rows] @ own
            best.append((rows, near, left))
            every = np.concatenate([np.repeat(n, m) for _, n, m in best])
            if len(every) >= k:
                kth = np.partition(every, len(every) - k)[len(every) - k]
                keep = [(r[n >= kth - 1e-9], n[n >= kth - 1e-9], m[n >= kth - 1e-9]) for r, n, m in best]
                best = [x for x in keep if len(x[0])]
        if not any(len(r) for r, _, _ in best):
            return
        rows = np.concatenate([r for r, _, _ in best])
        exact = (self.vectors[rows] * q).sum(1) / (self.norms[rows] * math.sqrt((q * q).sum()))
        # of each point the k smallest ids, which may be those beyond the query's own
        own_ids = [self.members[self.begin[r] : self.begin[r] + self.count[r]] for r in rows]
        own_ids = [np.concatenate([x[: np.searchsorted(x, query_id)][:k], x[np.searchsorted(x, query_id, "right") :][:k]])[:k] for x in own_ids]
        found, exact = np.concatenate(own_ids), np.repeat(exact, [len(x) for x in own_ids])
        for i in np.lexsort((found, -exact))[:k]:
            yield int(query_id), int(found[i]), float(exact[i])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of vectors (vec_id, embedding) found for each row of queries."""
    n = partitions(vectors.sparkSession)
    x = F.col("x")
    usable = (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x")).where("id IS NOT NULL AND x IS NOT NULL").where(usable).withColumn("length", F.size("x"))

    rows = clean(vectors).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    one = clean(queries).groupBy("id").agg(F.min("x").alias("x")).withColumn("length", F.size("x"))

    def packed(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for a, b in _runs(lengths):
                length, part = int(lengths[a]), batch.slice(a, b - a)
                ids, flat, size = part.column("id").to_numpy(), _matrix(part, length), max(1, PACK // (8 * length))
                out = [(length, ids[i : i + size].tobytes(), flat[i : i + size].tobytes()) for i in range(0, len(ids), size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["length", "ids", "matrix"])

    asked = one.select("id", "length", "x").sortWithinPartitions("length").mapInArrow(packed, "length int, ids binary, matrix binary")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def search(batches):
        key, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "length", "pack")], axis=1)
            for a, b in _runs(keys):
                (number, length, pack), part = keys[a].tolist(), batch.slice(a, b - a)
                if key != (number, length):
                    key, held, block = (number, length), [], None
                if not pack:
                    held.append((part.column("id").to_numpy(), _matrix(part, length)))
                    continue
                if not held:
                    continue  # queries without a row of their length in this block
                if block is None:
                    ids = np.concatenate([x for x, _ in held])
                    order = np.argsort(ids, kind="stable")
                    block = Block(ids[order], _scaled(np.concatenate([x for _, x in held]))[order], k, confidence)
                    held = [True]  # the block keeps its own arrays
                found = []
                for some, matrix in zip(part.column("ids").to_pylist(), part.column("matrix").to_pylist(), strict=True):
                    found += block.nearest(np.frombuffer(some, np.int64), _scaled(np.frombuffer(matrix, np.float64).reshape(-1, length)))
                    if len(found) >= 20_000:
                        yield _found(found)
                        found = []
                yield _found(found)

    # the rows of a block come first and are held; the packs of queries then stream past them
    both = rows.withColumn("pack", F.lit(0)).unionByName(asked.withColumn("pack", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("block", "length").sortWithinPartitions("block", "length", "pack")
    found = both.mapInArrow(lean_batches(search), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    differs = (keys[1:] != keys[:-1]).reshape(len(keys) - 1, -1).any(1) if len(keys) > 1 else np.zeros(0, bool)
    ends = [*(np.flatnonzero(differs) + 1).tolist(), len(keys)]
    return [(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True) if a < b]


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
