"""Fusion of ranked hits from many engines and queries into one ranking.

Hits have title, url, snippet, provider, query, rank (from 0), published_date and pos, the place of
a row in its leg; a leg is one engine's answer to one query. Rows are folded in the order
(priority of the engine, place of the query, pos), so results do not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.constants import PRIORITY, ROW_CAP, RRF_K, WEIGHT


def _lookup(values: dict, key: Column, default=None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    out = F.try_element_at(table, key)
    return out if default is None else F.coalesce(out, F.lit(default))


#: Column of each call's queries, where they differ.
ASKED = "_asked"


def _queries(queries: list[str] | DataFrame | None) -> Column:
    if isinstance(queries, DataFrame):
        return F.coalesce(ASKED, F.array().cast("array<string>"))
    return F.array(*[F.lit(q) for q in queries or []]).cast("array<string>")


def query_places(queries: list[str] | DataFrame | None) -> Column:
    """Place of the column query among queries; others follow, ordered by text."""
    asked = _queries(queries)
    at = F.array_position(asked, F.col("query"))
    known = at > 0
    return F.struct(F.when(known, at - 1).otherwise(F.size(asked)).cast("int").alias("at"), F.when(known, "").otherwise(F.col("query")).alias("text"))


def keyed_hits(hits: DataFrame, queries: list[str]) -> DataFrame:
    """Hits with url_key, leg and fold order; rows without a key are dropped."""
    key = U.url_key(F.col("url"))
    priority = _lookup(PRIORITY, F.col("provider"), 99)
    out = hits.withColumn("url_key", key).withColumn("priority", priority).withColumn("leg", F.struct("priority", query_places(queries).alias("query")))
    return out.where(F.trim("url_key") != "").withColumn("fold", F.struct("leg", "pos"))


def leg_ranks(hits: DataFrame) -> DataFrame:
    """Best rank of each URL in each leg, with the leg's weight."""
    return hits.groupBy("url_key", "leg").agg(F.min("rank").alias("rank"), F.first("provider").alias("provider")).withColumn("weight", _lookup(WEIGHT, F.col("provider"), 1.0))


def rrf(legs: Column) -> Column:
    """Sum of weight / (60 + rank + 1) over an array of (rank, weight), in sorted order so that its bits do not vary."""
    return F.aggregate(F.array_sort(legs), F.lit(0.0), lambda total, x: total + x["weight"] / (F.lit(RRF_K) + x["rank"].cast("double") + F.lit(1.0)))


def fuse(hits: DataFrame, queries: list[str] | DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """One row for each URL: representatives, providers, queries, best_rank, hit_count, published_date and score.

    by: columns that separate independent searches. queries: those of the one search, or a row (by, queries) for each. Two aggregates on nested keys; Catalyst shuffles once on the URL's key when it can.
    """
    by = by or []
    if isinstance(queries, DataFrame):
        hits = hits.join(queries.select(*by, F.col("queries").alias(ASKED)), by, "left")
        by = [*by, ASKED]
    rows = keyed_hits(hits, queries)
    first = F.struct("rank", "fold")
    snippet = F.coalesce("snippet", F.lit(""))
    legs = rows.groupBy(*by, "url_key", "leg").agg(
        F.min("rank").alias("rank"),
        F.first("provider").alias("provider"),
        F.first("query").alias("query"),
        F.min_by(F.struct(F.col("title"), F.col("url")), first).alias("best"),
        F.min(first).alias("best_at"),
        F.max_by(snippet, F.struct(F.octet_length(snippet).alias("n"), (-F.col("pos")).alias("o"))).alias("snippet"),
        F.min_by(F.col("published_date"), F.when(F.col("published_date").isNotNull(), F.col("pos"))).alias("date"),
        F.count("*").alias("hits"),
    )
    legs = legs.withColumn("weight", _lookup(WEIGHT, F.col("provider"), 1.0))
    longest = F.struct((-F.octet_length("snippet")).alias("n"), "leg")  # of equal ones the first in fold order
    groups = legs.groupBy(*by, "url_key").agg(
        F.min_by("best", "best_at").alias("best"),
        F.min("rank").alias("best_rank"),
        F.min_by("snippet", longest).alias("snippet"),
        F.min_by("date", F.when(F.col("date").isNotNull(), F.col("leg"))).alias("published_date"),
        F.transform(F.array_sort(F.collect_set(F.struct(F.col("leg.priority").alias("p"), "provider"))), lambda x: x["provider"]).alias("providers"),
        F.array_sort(F.collect_set("query")).alias("queries"),
        F.sum("hits").alias("hit_count"),
        rrf(F.collect_list(F.struct("rank", "weight"))).alias("rrf"),
    )
    terms = F.transform(_queries(queries), T.query_terms)
    out = groups.select(*by, "url_key", F.col("best.title").alias("title"), F.col("best.url").alias("display_url"), "snippet", "providers", "queries", "best_rank", "hit_count", "published_date", "rrf")
    return out.withColumn("score", F.col("rrf") * T.coverage(terms, F.col("title"), F.col("display_url"), F.col("snippet"))).drop(ASKED)


ORDER = [F.desc, F.desc, F.asc, F.asc]


def ranked(fused: DataFrame, top_k: int | None = None, by: list[str] | None = None) -> DataFrame:
    """position from 1 by score, number of queries, best rank and URL; the first top_k of each search."""
    order = [F.desc("score"), F.desc(F.size("queries")), F.asc("best_rank"), F.asc("display_url"), F.asc("url_key")]
    window = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)
    if not by and top_k:  # the k best of all rows need no single-partition sort of everything
        fused = fused.orderBy(*order).limit(top_k)
    out = fused.withColumn("position", F.row_number().over(window))
    return out.where(F.col("position") <= top_k) if top_k else out


def restamp(rows: DataFrame, leg: list[str], cap: int = ROW_CAP) -> DataFrame:
    """Rows of a paged leg (page, pos): first appearance of each URL, ranks from 0 across pages, at most cap."""
    seen = Window.partitionBy(*leg, "url").orderBy("page", "pos")
    order = Window.partitionBy(*leg).orderBy("page", "pos")
    first = rows.withColumn("_n", F.row_number().over(seen)).where("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < cap)


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in a stated order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
