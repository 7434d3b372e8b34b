"""Replay of recorded searches and pages: exact, then overlapping, then pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.constants import DEFAULT_TOP_K, MAX_TOP_K
from .fusion import first_wins


def page_outcomes(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One outcome for each key (pos, is_page): the first page, or the last failure if there is none."""
    order = [F.desc("is_page"), F.when(F.col("is_page"), F.col("pos")).otherwise(-F.col("pos"))]
    window = Window.partitionBy(*(by or []), "url_key").orderBy(*order)
    return pages.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def find_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """requests (url) with the outcome recorded under the requested key, else under the final URL of a page."""
    direct = page_outcomes(pages).select("url_key", F.struct("*").alias("d"))
    alias = first_wins(pages.where("is_page").withColumn("url_key", U.url_key(F.col("final_url"))), ["url_key"], "pos").select("url_key", F.struct("*").alias("a"))
    out = requests.withColumn("url_key", U.url_key(F.col("url"))).join(direct, "url_key", "left").join(alias, "url_key", "left")
    return out.select("url", "url_key", F.coalesce("d.pos", "a.pos").alias("pos"), F.coalesce("d.is_page", "a.is_page").alias("is_page"))


def missing_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests that no recording answers."""
    keyed = requests.withColumn("url_key", U.url_key(F.col("url")))
    both = pages.select(F.explode(F.array(F.col("url_key"), F.when(F.col("is_page"), U.url_key(F.col("final_url"))))).alias("url_key"))
    return keyed.join(both, "url_key", "left_anti")


def _best(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first rows of each group in the order of a replay: hits with a recorded page, then as recorded. Each task cuts its own first."""
    order = Window.partitionBy(*by).orderBy(F.desc("has_page"), "pos", "at")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def replay(requests: DataFrame, searches: DataFrame, hits: DataFrame, pages: DataFrame) -> DataFrame:
    """What recorded searches answer: request_id, tier, rank (from 0), url.

    requests: request_id, queries, top_k. searches: pos, queries. hits: pos (of the search), at (within it), url, queries
    (those that found the hit). pages: is_page, url_key, final_url.
    Tier 1: the first search with the same set of queries answers as it did. Tier 2: else the hits that any of the
    queries found. Tier 3: else all hits. In tiers 2 and 3 a URL counts once, those with a recorded page come first, and
    top_k is the end. The order does not depend on a request, so a query keeps only as many of its hits as any
    request can ask for, and a request meets those lists, not the hits.
    """
    asked = requests.withColumn("q", T.query_set(F.col("queries"))).withColumn("top_k", F.greatest(F.lit(1), F.least(F.lit(MAX_TOP_K), F.coalesce("top_k", F.lit(DEFAULT_TOP_K))))).drop("queries")
    asked = asked.withColumn("k", F.array_join("q", "\x01"))
    first = searches.groupBy(F.array_join(T.query_set(F.col("queries")), "\x01").alias("k")).agg(F.min("pos").alias("pos"))
    same = asked.join(first, "k").select("request_id", "pos")
    exact = same.join(hits.select("pos", "at", "url"), "pos", "left").withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy("at")) - 1)
    exact = exact.select("request_id", F.lit(1).alias("tier"), F.when(F.col("url").isNotNull(), F.col("rank")).alias("rank"), "url")

    read = pages.where("is_page").select(F.explode(F.array_distinct(F.array("url_key", U.url_key(F.col("final_url"))))).alias("url_key")).where("url_key IS NOT NULL").distinct().withColumn("has_page", F.lit(True))
    known = hits.withColumn("url_key", U.url_key(F.col("url"))).join(read, "url_key", "left").withColumn("has_page", F.coalesce("has_page", F.lit(False)))
    one = lambda rows, by: rows.groupBy(*by, "url").agg(F.min(F.struct("pos", "at")).alias("f"), F.max("has_page").alias("has_page")).select(*by, "url", "f.pos", "f.at", "has_page")
    found = known.select(F.explode(T.query_set(F.col("queries"))).alias("query"), "url", "pos", "at", "has_page")
    lists = _best(one(found, ["query"]), ["query"], MAX_TOP_K)
    rest = asked.join(same.select("request_id"), "request_id", "left_anti")
    met = one(rest.select("request_id", F.explode("q").alias("query")).join(lists, "query"), ["request_id"])
    pooled = one(known, []).orderBy(F.desc("has_page"), "pos", "at").limit(MAX_TOP_K)  # a list of a fixed length
    lost = rest.join(met.select("request_id").distinct(), "request_id", "left_anti").select("request_id")
    pooled = pooled.agg(F.collect_list(F.struct(pooled.columns)).alias("list")).withColumn("_all", F.lit(1))
    every = lost.withColumn("_all", F.lit(1)).join(F.broadcast(pooled), "_all").select("request_id", F.inline("list"))
    some = met.withColumn("tier", F.lit(2)).unionByName(every.withColumn("tier", F.lit(3)))
    order = Window.partitionBy("request_id").orderBy(F.desc("has_page"), "pos", "at")
    cut = some.withColumn("rank", F.row_number().over(order) - 1).join(rest.select("request_id", "top_k"), "request_id").where(F.col("rank") < F.col("top_k"))
    return exact.unionByName(cut.select("request_id", "tier", "rank", "url"))


def pool(hits: DataFrame, pages: DataFrame, top_k: int) -> DataFrame:
    """All recorded hits (pos, url) once by URL key, those with a recorded page first, the first top_k."""
    one = first_wins(hits.withColumn("url_key", U.url_key(F.col("url"))), ["url_key"], "pos")
    has = pages.where("is_page").select("url_key").distinct().withColumn("has_page", F.lit(True))
    out = one.join(has, "url_key", "left").withColumn("has_page", F.coalesce("has_page", F.lit(False)))
    return out.orderBy(F.desc("has_page"), "pos").limit(top_k)
