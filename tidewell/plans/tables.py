"""Inputs of the queries, made from the driver's tables in the same way as in their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROVIDER = {"error": "startpage", "click": "brave", "view": "yahoo", "signup": "duckduckgo", "purchase": "bing"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def millis(c):
    """Milliseconds since 1970 of a timestamp with or without a zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a ranked hit: an engine for each type, eight queries, a hundred sites."""
    e = table(spark, folder, "events").select("event_id", "ts", F.pmod("user_id", F.lit(8)).alias("u"), "event_type", _k().alias("k"))
    names = F.create_map(*[F.lit(x) for p in PROVIDER.items() for x in p])
    e = e.withColumn("provider", F.try_element_at(names, F.col("event_type"))).withColumn("query", F.concat(F.lit("q"), F.col("u").cast("string")))
    rank = F.row_number().over(Window.partitionBy("provider", "query").orderBy("ts", "event_id")) - 1
    e = e.withColumn("rank", rank)
    site = F.col("k").cast("string")
    return e.select(
        F.concat(F.lit("Page "), site).alias("title"), F.concat(F.lit("https://www.Site"), site, F.lit(".example.com/p/"), F.when(F.col("k") % 3 == 0, "#top").otherwise("")).alias("url"),
        F.concat(F.lit("about "), F.repeat(F.lit("x"), F.col("k") % 7)).alias("snippet"), "provider", "query", "rank", F.when(F.col("k") % 5 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("published_date"), F.col("rank").alias("pos"),
    )


HITS_SQL = """
e0 AS (SELECT event_id, ts, user_id % 8 AS u, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
e1 AS (SELECT *, CASE event_type WHEN 'error' THEN 'startpage' WHEN 'click' THEN 'brave' WHEN 'view' THEN 'yahoo' WHEN 'signup' THEN 'duckduckgo' ELSE 'bing' END AS provider,
              CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS prio, 'q' || u AS query FROM e0),
e2 AS (SELECT *, row_number() OVER (PARTITION BY provider, query ORDER BY ts, event_id) - 1 AS rank FROM e1),
hits AS (SELECT 'Page ' || k AS title, 'https://www.Site' || k || '.example.com/p/' || CASE WHEN k % 3 = 0 THEN '#top' ELSE '' END AS url,
                'about ' || repeat('x', k % 7) AS snippet, provider, prio, query, u, rank, CASE WHEN k % 5 = 0 THEN strftime(ts, '%Y-%m-%d') END AS published_date,
                'site' || k || '.example.com/p' AS url_key FROM e2)
"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as evaluation runs: a goal for each user, clicks as arm A and views as arm B."""
    e = table(spark, folder, "events").withColumn("k", _k())
    return e.where("event_type IN ('click', 'view')").select(
        F.col("user_id").cast("string").alias("goal_id"), F.concat(F.lit("c"), F.pmod("user_id", F.lit(7)).cast("string")).alias("category"), F.col("event_id").alias("repeat"), F.when(F.col("event_type") == "click", "a").otherwise("b").alias("arm"),
        F.when(F.col("k") % 10 == 0, 1).otherwise(0).alias("exit_code"), (F.col("k") % 13).alias("turns_used"), (F.col("k") * 1000).cast("long").alias("total_tokens"), F.when(F.col("k") % 4 != 0, F.col("k") % 9).alias("citations"),
        (F.col("k") % 5).alias("exact"), (F.col("k") % 5 + F.col("k") % 3).alias("cited"), F.floor(F.col("value") * 100).alias("wall_ms"), F.when(F.col("k") % 6 == 0, F.lit(None)).when(F.col("k") % 3 == 0, "CORRECT").when(F.col("k") % 3 == 1, "INCORRECT").otherwise("NOT_ATTEMPTED").alias("grade"),
        F.when(F.col("k") % 6 != 0, (F.col("k") % 11) / 10.0).alias("core_recall"), F.when(F.col("k") % 4 == 1, (F.col("k") % 9) / 8.0).alias("supporting_recall"), F.when(F.col("k") % 6 != 0, (F.col("k") % 7) / 6.0).alias("nugget_recall"),
        F.when(F.col("k") % 2 == 0, F.array(F.lit("supported"), F.when(F.col("k") % 3 == 0, "partly").otherwise("uncited"))).alias("verdicts"), F.col("value"),
    )


RUNS_SQL = """
r0 AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_type IN ('click', 'view')),
runs AS (SELECT CAST(user_id AS VARCHAR) AS goal_id, 'c' || (user_id % 7) AS category, event_id AS repeat, CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END AS arm,
  CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS exit_code, k % 13 AS turns_used, k * 1000 AS total_tokens, CASE WHEN k % 4 <> 0 THEN k % 9 END AS citations,
  k % 5 AS exact, k % 5 + k % 3 AS cited, CAST(floor(value * 100) AS BIGINT) AS wall_ms,
  CASE WHEN k % 6 = 0 THEN NULL WHEN k % 3 = 0 THEN 'CORRECT' WHEN k % 3 = 1 THEN 'INCORRECT' ELSE 'NOT_ATTEMPTED' END AS grade,
  CASE WHEN k % 6 <> 0 THEN (k % 11) / 10.0::DOUBLE END AS core_recall, CASE WHEN k % 4 = 1 THEN (k % 9) / 8.0::DOUBLE END AS supporting_recall, CASE WHEN k % 6 <> 0 THEN (k % 7) / 6.0::DOUBLE END AS nugget_recall,
  CASE WHEN k % 2 = 0 THEN ['supported', CASE WHEN k % 3 = 0 THEN 'partly' ELSE 'uncited' END] END AS verdicts, value FROM r0)
"""


def engine_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as request outcomes of six engines."""
    e = table(spark, folder, "events").withColumn("k", _k())
    bad = F.col("event_type") == "error"
    kind = F.when(~bad, "ok").when(F.col("k") % 4 == 0, "challenge").otherwise("upstream")
    status = F.when(bad & (F.col("k") % 4 == 1), 403).when(bad & (F.col("k") % 4 == 2), 429).when(bad & (F.col("k") % 4 == 3), 503)
    return e.select(F.concat(F.lit("e"), F.pmod("user_id", F.lit(6)).cast("string")).alias("engine"), millis("ts").alias("ts"), F.col("event_id").alias("ordinal"), kind.alias("kind"), status.alias("status"), F.when(bad & (F.col("k") % 20 == 7), F.lit(5000)).cast("long").alias("retry_after"))


LOG_SQL = """
l0 AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
log AS (SELECT 'e' || (user_id % 6) AS engine, epoch_us(ts) // 1000 AS ts, event_id AS ordinal, event_type = 'error' AS bad,
  CASE WHEN event_type <> 'error' THEN NULL WHEN k % 4 = 0 THEN 3600 WHEN k % 20 = 7 THEN 3600 WHEN k % 4 IN (1, 2) THEN 180 ELSE 30 END AS secs,
  CASE WHEN event_type <> 'error' THEN NULL WHEN k % 4 = 0 THEN 'challenge' WHEN k % 20 = 7 THEN 'retry_after' WHEN k % 4 = 1 THEN 'http_403' WHEN k % 4 = 2 THEN 'http_429' ELSE 'upstream' END AS why FROM l0)
"""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or on this machine where Spark runs here alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or f'file://{tempfile.gettempdir()}/tidewell').rstrip('/')}/{name}-{uuid.uuid4().hex}"
