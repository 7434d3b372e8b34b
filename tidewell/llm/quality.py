"""Quality classifier: features of whole texts, scored by a generalised additive model with pairwise interactions.

The model is fitted on the driver from the features (numbers, no texts) of at most SAMPLE
labelled documents, those with the smallest hashes of their ids; every document is scored.

Cases: null text counts as empty and is scored like it; a label without a document, or null,
is not used; a document with several labels counts once for each; without labels, or with one label only, all
scores are equal; a null doc_id has the fold of the empty string, whose checksum is 0; rows are scored one by
one, also with equal ids; further columns are not used; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gam, tokens
from .shared import lean_batches

SAMPLE = 20_000
FOLDS, HELD_OUT = 3, 1
SLICE = 1 << 20
FEATURES = ["log_words", "upper", "digits", "marks", "bars", "odd", "mean_word", "spread_word", "distinct", "again", "trigrams", "lines", "line_words", "ends", "long_words", "blank", "top"]
SCORED = "doc_id long, held_out boolean, score double"


def _classes() -> dict[str, np.ndarray]:
    def of(chars: bytes) -> np.ndarray:
        table = np.zeros(256, dtype=np.int32)
        table[list(chars)] = 1
        return table

    return {
        "upper": of(bytes(range(65, 91))),
        "lower": of(bytes(range(97, 123))),
        "digits": of(bytes(range(48, 58))),
        "marks": of(b"!#$%&*+=<>@^_~\\{}[]"),
        "bars": of(b"|"),
        "ends": of(b".?!"),
        "lines": of(b"\n"),
        "blank": of(b" \t\n\r\x0b\x0c"),
        "high": of(bytes(range(128, 256))),
    }


CLASSES = _classes()


def features(column) -> np.ndarray:
    """One row of FEATURES for each text, worked out for about SLICE bytes at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto, start, out = np.cumsum(sizes, dtype=np.int64), 0, []
    while start < len(column):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + SLICE, "right")))
        out.append(_features(column.slice(start, stop - start)))
        start = stop
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _features(column) -> np.ndarray:
    data, offsets = tokens.column_bytes(column)
    words = tokens.tokenise(column, "blank", spans=True)
    n = len(offsets) - 1
    counts = words.counts
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    step = 1 << 22
    chars = {}
    for name, table in CLASSES.items():
        parts = [np.cumsum(table[data[a : a + step]], dtype=np.int64) for a in range(0, len(data), step)]
        base = 0
        for p in parts:
            p += base
            base = int(p[-1])
        total = np.concatenate([[0], *parts])
        chars[name] = (total[offsets[1:]] - total[offsets[:-1]]).astype(float)
        del parts, total
    some = np.maximum(counts, 1).astype(float)
    lengths = (words.end - words.start).astype(float)
    mean = per_row(lengths, words.first) / some
    square = per_row(lengths * lengths, words.first) / some
    again = np.zeros(len(words.hash), dtype=bool)
    again[1:] = words.hash[1:] == words.hash[:-1]
    again[words.first[:-1][counts > 0]] = False
    distinct, top, tri = np.ones(n), np.zeros(n), np.ones(n)
    third = tokens.rolling(words.hash, 3)
    for i in np.flatnonzero(counts):
        a, b = words.first[i], words.first[i + 1]
        own = np.sort(words.hash[a:b])
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        distinct[i] = len(new) / (b - a) ** 0.75
        top[i] = np.diff(np.append(new, b - a)).max() / (b - a)
        if b - a >= 3:
            t = np.sort(third[a : b - 2])
            tri[i] = (1 + np.count_nonzero(t[1:] != t[:-1])) / len(t)
    letters = np.maximum(chars["upper"] + chars["lower"], 1)
    lines = chars["lines"] + 1
    odd = size - sum(chars[c] for c in ("upper", "lower", "digits", "blank", "high"))
    columns = [
        np.log1p(counts), chars["upper"] / letters, chars["digits"] / size, chars["marks"] / some, chars["bars"] / some, odd / some, mean,
        np.sqrt(np.maximum(square - mean * mean, 0)), distinct, per_row(again, words.first) / some, tri, np.log1p(lines), counts / lines,
        chars["ends"] / some, per_row(lengths > 16, words.first) / some, chars["blank"] / size, top,
    ]
    return np.stack([np.asarray(c, dtype=float) for c in columns], axis=1) if n else np.zeros((0, len(FEATURES)))


def _fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> gam.Gam:
    """Fits the model on labelled documents outside the held-out fold."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(_fold() != HELD_OUT).select("doc_id", "quality")
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))  # at most sample pairs of numbers
    known = docs.select("doc_id", "text").join(chosen, "doc_id")

    def measure(batches):
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # a doc_id may have many rows: of those, too, at most sample are fitted
    rows = known.mapInArrow(lean_batches(measure), "doc_id long, quality int, x array<double>").orderBy(F.xxhash64("doc_id", "x"), "doc_id", "quality", "x").limit(sample).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort(tuple(x.T[::-1]))  # rows with equal ids in an order of their own
    return gam.fit(x[order], rows.column("quality").to_numpy().astype(float)[order])


def score(docs: DataFrame, model: gam.Gam) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""

    def run(batches):
        for batch in batches:
            s = model.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s)], names=["doc_id", "held_out", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _fold().eqNullSafe(F.lit(HELD_OUT)).alias("held_out"))
    return source.mapInArrow(lean_batches(run), SCORED).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: gam.Gam) -> DataFrame:
    """The rows of docs, all columns, that the model does not reject; all of them where labels of one kind only told nothing."""
    if not model.pair_edges:
        return docs

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column("text"))) >= 0.5))

    return docs.mapInArrow(lean_batches(run), docs.schema)
