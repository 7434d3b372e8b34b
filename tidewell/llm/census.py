"""Ask the whole corpus about 64-bit keys without a row for each key.

Documents are dealt into blocks. Each block sends its sorted distinct keys, cut into ranges of the
key space, as packed binaries; whoever holds a range sees a key at most once from each block however
often it occurs, and answers each block with an array that is aligned with the keys it sent. No key is
hot: the most that meets in one place is one entry for each block. Blocks follow
spark.sql.shuffle.partitions.

Ranges are the leading bits of a key and blocks meet in a tree. A block sends a row to each of at most
2**FAN_BITS ranges; a node joins the keys that so many neighbouring blocks have in one range and passes them
on, cut finer, until all blocks have met. So n blocks send n * fan * log(n) / log(fan) rows, not n * n, and a
node holds about as many keys as a block. Answers go down the same tree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean

BLOCK = "_block"
#: A node has at most 2**FAN_BITS children.
FAN_BITS = 6
U = np.uint64
ASKED = "grp int, path long, kind int, child int, keys binary, vals binary"
TOLD = "grp int, path long, kind int, said binary, n_total long, n_keys long"


def hashed_blocks(docs: DataFrame, n: int) -> DataFrame:
    """Deal rows by id and text, so that rows of one id, or without any, do not meet in one block."""
    return docs.withColumn(BLOCK, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def ordered_blocks(docs: DataFrame, n: int) -> DataFrame:
    """Deal rows so that a smaller block has smaller doc_ids throughout; rows without an id go to any block."""
    cuts = docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    found = np.array(sorted(set(cuts)))

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(found, ids.to_numpy(dtype=float), "left").astype(np.int32))

    lost = F.pmod(F.xxhash64("text"), F.lit(len(found) + 1)).cast("int")
    at: Column = block(F.coalesce(F.col("doc_id"), F.lit(0))) if len(found) else F.lit(0)
    return docs.withColumn(BLOCK, F.when(F.col("doc_id").isNull(), lost).otherwise(at))


def shape(n: int, fan_bits: int | None = None) -> tuple[int, int]:
    """Levels of the tree over n blocks, and bits of a key that each level looks at."""
    need = max(1, (n - 1).bit_length())
    levels = -(-need // (fan_bits or FAN_BITS))
    return levels, -(-need // levels)


def cut_short(keys: np.ndarray, n: int, keep: int) -> np.ndarray:
    """Keys with only `keep` bits beyond those that tell their last range; the rest is 0."""
    levels, bits = shape(n)
    drop = U(max(0, 64 - levels * bits - keep))
    return keys >> drop << drop


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of the fewest bytes that hold them all; low bits that are 0 in all of them are left out."""
    if not len(keys):
        return bytes(10)
    every = int(np.bitwise_or.reduce(keys))
    low = max(0, (every & -every).bit_length() - 1)
    steps = np.diff(keys, prepend=keys[:1]) >> U(low)
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width, low]) + int(keys[0]).to_bytes(8, "little") + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    width, low = max(1, packed[0]), packed[1]
    steps = np.frombuffer(packed, np.uint8, offset=10).reshape(-1, width)
    out = np.zeros((len(steps), 8), np.uint8)
    out[:, :width] = steps
    out = out.view("<u8").reshape(-1).astype(U) << U(low)
    if len(out):
        out[0] = int.from_bytes(packed[2:10], "little")
    return np.cumsum(out, dtype=U)


def _narrow(x: np.ndarray) -> bytes:
    """The same counts in the narrowest unsigned type that holds them; truths as bits."""
    if x.dtype == bool:
        return np.packbits(x).tobytes()
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def _wide(packed: bytes, n: int, bits: bool = False) -> np.ndarray:
    if bits:
        return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
    return np.frombuffer(packed, f"u{len(packed) // n}").astype(U) if packed else np.zeros(n, U)


def _ranges(keys: np.ndarray, path: int, level: int, bits: int) -> np.ndarray:
    """Where each of the 2**bits ranges of this level begins in sorted keys that lie in path, and their number."""
    first = np.array([((path << bits) + i) << (64 - bits * level) for i in range(1 << bits)], dtype=U)
    return np.append(np.searchsorted(keys, first), len(keys))


def _send(rows: list, keys: np.ndarray, counts: np.ndarray | None, child: int, kind: int, path: int, level: int, bits: int) -> None:
    at = _ranges(keys, path, level, bits)
    for i in range(1 << bits):
        part = slice(at[i], at[i + 1])
        rows.append((child >> bits, (path << bits) + i, kind, child, pack(keys[part]), _narrow(counts[part]) if counts is not None else b""))


def _table(rows: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


class _Meeting:
    """What the children of a node sent of one kind: the distinct keys of all, their summed counts, and who sent what."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("child")
        self.grp, self.path, self.kind = (table.column(c)[0].as_py() for c in ("grp", "path", "kind"))
        self.children = table.column("child").to_pylist()
        lists = [unpack(x) for x in table.column("keys").to_pylist()]
        counts = [_wide(x, len(k)) for x, k in zip(table.column("vals").to_pylist(), lists, strict=True)]
        self.sizes = [len(k) for k in lists]
        keys, counts = np.concatenate(lists), np.concatenate(counts)
        del lists
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        head = np.empty(len(keys), dtype=bool)
        head[:1], head[1:] = True, ranked[1:] != ranked[:-1]
        self.keys = ranked[head]
        self.sums = np.add.reduceat(counts[order], np.flatnonzero(head)) if len(keys) else counts
        self.which = np.empty(len(keys), dtype=np.int32)
        self.which[order] = np.cumsum(head, dtype=np.int32) - 1
        self.lead = np.zeros(len(keys), dtype=bool)
        self.lead[order[head]] = True

    def told(self, said: np.ndarray, again: bool, total: int, n_keys: int) -> pa.Table:
        """The answers to the distinct keys, handed to the children."""
        out = said[self.which] | ~self.lead if again else said[self.which]
        parts = np.split(out, np.cumsum(self.sizes)[:-1])
        return _table([(c, self.path, self.kind, _narrow(x), total, n_keys) for c, x in zip(self.children, parts, strict=True)], TOLD)


def census(
    blocks: DataFrame,
    keys_of: Callable[[pa.Table], list[tuple[np.ndarray, np.ndarray | None]]],
    n: int,
    reply: Callable[[np.ndarray], np.ndarray] | None = None,
    fan_bits: int | None = None,
) -> DataFrame:
    """Answers for n blocks (grp: the block, path: the range; read them by told).

    keys_of: table of a block -> [(sorted distinct keys, counts or None)] by kind. reply: sums of counts ->
    an answer for each key. Without reply the answer tells whether an earlier block has the key as well.
    """
    levels, bits = shape(n, fan_bits)
    again = reply is None

    def first(table: pa.Table) -> pa.Table:
        rows: list = []
        block = table.column(BLOCK)[0].as_py()
        for kind, (keys, counts) in enumerate(keys_of(table)):
            _send(rows, keys, counts, block, kind, 0, 1, bits)
        return _table(rows, ASKED)

    def pass_on(level: int):
        def up(table: pa.Table) -> pa.Table:
            met, rows = _Meeting(table), []
            _send(rows, met.keys, None if again else met.sums, met.grp, met.kind, met.path, level + 1, bits)
            return _table(rows, ASKED)

        return lean(up)

    def answer(table: pa.Table) -> pa.Table:
        met = _Meeting(table)
        said = np.zeros(len(met.keys), dtype=bool) if again else reply(met.sums)
        return met.told(said, again, int(met.sums.sum()), int((met.sums > 0).sum()))

    def hand_down(level: int):
        def down(table: pa.Table, said: pa.Table) -> pa.Table:
            met = _Meeting(table)
            heard = said_of(said, met.kind, _ranges(met.keys, met.path, level + 1, bits), again)
            return met.told(heard, again, sum(said.column("n_total").to_pylist()), sum(said.column("n_keys").to_pylist()))

        return lean(down)

    node = ["grp", "path", "kind"]
    asked = [blocks.groupBy(BLOCK).applyInArrow(lean(first), ASKED)]
    for level in range(1, levels):
        asked.append(asked[-1].groupBy(*node).applyInArrow(pass_on(level), ASKED))
    said = asked[-1].groupBy(*node).applyInArrow(lean(answer), TOLD)
    for level in range(levels - 1, 0, -1):
        said = said.withColumn("up", F.shiftright("path", bits))
        said = asked[level - 1].groupBy(*node).cogroup(said.groupBy("grp", "up", "kind")).applyInArrow(hand_down(level), TOLD)
    return said


def said_of(table: pa.Table, kind: int, at: np.ndarray, truths: bool) -> np.ndarray:
    rows = sorted((p, s) for p, k, s in zip(*[table.column(c).to_pylist() for c in ("path", "kind", "said")], strict=True) if k == kind)
    parts = [_wide(s, m, truths) for (_, s), m in zip(rows, np.diff(at), strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, bool if truths else U)


def told(table: pa.Table, kind: int, keys: np.ndarray, n: int, truths: bool = False, fan_bits: int | None = None) -> np.ndarray:
    """The answers to a block's sorted distinct keys of one kind, in key order."""
    return said_of(table, kind, _ranges(keys, 0, 1, shape(n, fan_bits)[1]), truths)


def totals(table: pa.Table, kind: int) -> tuple[int, int]:
    """Over all keys of one kind: the sum of counts, and how many have one."""
    on = np.asarray(table.column("kind").to_pylist()) == kind
    return tuple(int(np.asarray(table.column(c).to_pylist(), dtype=np.int64)[on].sum()) for c in ("n_total", "n_keys"))
