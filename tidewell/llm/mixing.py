"""Mixing sources to target weights by pivotal dependent rounding.

Sources share RATIO times all words by weight; a target stops at CAP times its source's size and
the excess is shared again by weight. Every document of a source is due target / size copies: the
whole part is given, and the fractional parts are rounded against each other. Two documents with
open probabilities p and q and sizes a and b move mass between them so that p a + q b stays,
until one is 0 or 1; which of the two ends it is drawn so that each probability keeps its
expectation. What is left open in one stretch of a source meets the rest of other stretches in a
reduction tree, so a source of any size is worked on by many tasks. Large documents meet first, so what
is open at the end is mostly a short one; the words taken differ from the target by less than one document. Random numbers are
hashes of doc_id, size, the number of a row among equal ones, and the seed: reruns agree, however files are split.

Cases: null text has size 0 and takes nothing; a null source is a source, ordered last; a source
without words gets target 0; rows of equal id, source and size are told apart by a number only, so they are
counted first and then written out, and do not meet in one task; an empty table gives none; further columns are not used.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

WEIGHTS = (5, 2, 1)
RATIO = 1.5
CAP = 2.0
SEED = 20
#: Documents that one stretch of a source has, about, and residuals that one node of the tree joins.
STRETCH = 4096
FAN_IN = 64
NO_WORD = r"[^\x20\x09-\x0D]+"


def _ranked(sources: DataFrame) -> DataFrame:
    """rank: place of each source by code point, null last, from 0; counted in ranges, so no task gets all of them."""
    ranged = sources.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "source-ranges")
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets += [F.lit(part), F.lit(before)]
        before += counts[part]
    start = F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy("part").orderBy("none", "source"))
    return ranged.withColumn("rank", start + place - 1).drop("none", "part")


def targets(sizes: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """sizes (source, size) -> source, source_size, n_docs, target."""
    sources = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap)), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # each round fills at least one more source, or ends; most inputs need a few
        is_full = F.col("most") <= F.col("weight") * F.lit(level)
        got = sources.agg(F.sum(F.when(is_full, F.col("most"))), F.sum(F.when(~is_full, F.col("weight"))), F.count(F.when(is_full, 1))).first()
        if got[2] == full or not got[1]:
            break
        full, level = got[2], (total * ratio - (got[0] or 0.0)) / got[1]
    share = F.least("most", F.col("weight") * F.lit(float(level)))
    return sources.select("source", "source_size", "n_docs", share.alias("target"))


def _uniform(*parts) -> float:
    return (int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big") + 0.5) / 2.0**64


def _pivot(a, b, draw: float):
    """One meeting of (id, size, p) a and b: the one that is settled, with its 0 or 1, and the one that stays open or is settled too."""
    (i, s, p), (j, t, q) = a, b
    up = min(1.0 - p, q * t / s)  # p rises, q falls
    down = min(p, (1.0 - q) * t / s)  # p falls, q rises
    rise = draw * (up + down) < down
    p, q = (p + up, q - up * s / t) if rise else (p - down, q + down * s / t)
    return (i, s, _settled(p)), (j, t, _settled(q))


def _settled(p: float) -> float:
    return 0.0 if p < 1e-12 else 1.0 if p > 1 - 1e-12 else p


CARRIED = ["doc_id", "occ", "size", "p", "source", "source_size", "target", "whole"]
ROWS = "grp string, doc_id long, occ long, size long, p double, source string, source_size long, target double, whole long"
TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.float64(), pa.int64()]


def _reduce(level: int):
    """Rows sorted by group: settles all but one document of each group."""

    def run(batches):
        group, held, rest = None, None, None
        for batch in batches:
            out = []
            for g, doc, occ, size, p, *more in zip(*[batch.column(c).to_pylist() for c in ["grp", *CARRIED]], strict=True):
                if g != group:
                    if held is not None:
                        out.append((group, *held[0], *held[1:], *rest))
                    group, held = g, None
                here = ((doc, occ), size, p)
                if held is None:
                    held, rest = here, more
                    continue
                one, two = _pivot(held, here, _uniform(SEED, level, *held[0], held[1], doc, occ, size))
                kept = more
                if 0.0 < one[2] < 1.0:
                    one, two, rest, kept = two, one, more, rest
                out.append((g, *one[0], *one[1:], *rest))
                held, rest = two, kept
                if not 0.0 < two[2] < 1.0:
                    out.append((g, *two[0], *two[1:], *rest))
                    held = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=["grp", *CARRIED])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((group, *held[0], *held[1:], *rest), TYPES, strict=True)], names=["grp", *CARRIED])

    return run


def _numbered(sized: DataFrame) -> DataFrame:
    """A row for each row of (doc_id, source, size), with its number occ among equal ones, whatever the order of the input."""
    many = sized.groupBy("doc_id", "source", "size").count()
    many = many.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / STRETCH))))
    first = F.col("chunk") * STRETCH
    return many.withColumn("occ", F.explode(F.sequence(first + 1, F.least("count", first + STRETCH)))).drop("count", "chunk")


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken of each document."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(NO_WORD)), F.lit(0)).cast("long").alias("size"))
    sized = stored(_numbered(sized), "sizes")
    shares = targets(sized)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rate = sized.join(shares.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("rate", due)
    rate = rate.withColumn("whole", F.floor(F.col("rate") + F.lit(1e-12)).cast("long"))
    rate = stored(rate.withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))).drop("rate"), "rates")
    is_open = (F.col("p") > 1e-12) & (F.col("size") > 0)
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    at = F.pmod(F.xxhash64("doc_id", "size", "occ", F.lit(SEED)), F.ceil(F.col("n_docs") / STRETCH))
    open_ = rate.where(is_open).select(key.alias("key"), at.alias("at"), *CARRIED)
    most = rate.agg(F.max("n_docs")).first()[0] or 0
    done_ = [rate.where(~is_open).withColumn("p", F.lit(0.0)).select(*CARRIED)]
    width, level = max(1, -(-most // STRETCH)), 0
    while True:
        grp = F.concat("key", F.lit("\t"), F.col("at").cast("string"))
        dealt = open_.withColumn("grp", grp).repartition("grp").sortWithinPartitions("grp", F.desc("size"), F.xxhash64("doc_id", "occ", F.lit(SEED + level)), "doc_id", "occ")
        done = stored(dealt.select("grp", *CARRIED).mapInArrow(_reduce(level), ROWS), "rounded")
        done_.append(done.where("p <= 0 OR p >= 1").select(*CARRIED))
        open_ = done.where("p > 0 AND p < 1").select(
            F.expr("substring(grp, 1, length(grp) - length(substring_index(grp, '\t', -1)) - 1)").alias("key"),
            F.floor(F.substring_index("grp", "\t", -1).cast("long") / FAN_IN).alias("at"), *CARRIED,
        )
        level += 1
        if width <= 1:
            break
        width = -(-width // FAN_IN)
    last = F.pmod(F.xxhash64("doc_id", "size", "occ", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    all_ = open_.withColumn("p", (last < F.col("p")).cast("double")).select(*CARRIED)
    for part in done_:
        all_ = all_.unionByName(part)
    all_ = all_.withColumn("copies", F.col("whole") + F.col("p").cast("long"))
    return all_.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
