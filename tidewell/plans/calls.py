"""Queries of tool calls and their results: the texts of conversations as arguments, right and wrong by the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import search, tools
from .registry import query
from .tables import table

#: Rows as calls: what a row is, its text cut to 60 characters, and its kind of fault.
CALLS_SQL = """
c AS (SELECT conv_id, turn, coalesce(text, '') AS text, trim(substr(coalesce(text, ''), 1, 60), ' ' || chr(10)) AS q, (conv_id * 7 + turn) % 14 AS n, json_quote(substr(coalesce(text, ''), 1, 60)) AS j FROM conversations)
""".replace("json_quote(substr(coalesce(text, ''), 1, 60))", "CAST(to_json(substr(coalesce(text, ''), 1, 60)) AS VARCHAR)")


def _calls(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("q", F.substring("text", 1, 60)).withColumn("n", (F.col("conv_id") * 7 + F.col("turn")) % 14)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _by_kind(kinds: list[Column]) -> Column:
    out = kinds[0]
    for k, x in enumerate(kinds[1:], 1):
        out = F.when(F.col("n") == k, x).otherwise(out)
    return out


def _search_text() -> Column:
    one, turn = F.array("q"), F.col("turn")
    return _by_kind([
        _json(queries=F.array("q", F.lit("second  one "))), _json(queries=F.to_json(one), top_k=turn), _json(queries=one, recency=F.lit("week")), _json(queries=one, recency=F.col("q")), _json(queries=one, limit=turn), _json(top_k=turn),
        _json(queries=F.col("q")), _json(queries=one, top_k=F.lit(None).cast("int")), _json(queries=one, top_k=-turn - 1), _json(queries=one, top_k=F.lit(99_999_999_999)), _json(queries=F.array(turn, turn + 1)), F.to_json(F.array("q")), F.col("q"),
        _json(queries=F.transform(F.sequence(F.lit(0), F.lit(8).cast("long") + turn), lambda i: F.concat("q", i.cast("string")))),
    ])


@query(f"""
WITH {CALLS_SQL}
SELECT conv_id, turn,
 CASE n WHEN 0 THEN CASE WHEN q = '' THEN '' ELSE q || '|' END || 'second  one' WHEN 1 THEN nullif(q, '') WHEN 2 THEN nullif(q, '') WHEN 9 THEN nullif(q, '') END AS queries,
 CAST(CASE WHEN n = 0 THEN 15 WHEN q = '' THEN NULL WHEN n = 1 THEN greatest(turn, 1) WHEN n = 2 THEN 15 WHEN n = 9 THEN 30 END AS INT) AS top_k, CASE WHEN n = 2 AND q <> '' THEN 'week' END AS recency,
 CASE n WHEN 0 THEN NULL WHEN 3 THEN 'Provide recency as day|week|month|year; got ' || j || '.' WHEN 4 THEN 'Unknown argument `limit`; allowed: queries, top_k, recency.' WHEN 5 THEN 'Provide queries as an array of 1-8 strings; got missing.'
  WHEN 6 THEN 'Provide queries as an array of strings; got ' || j || '.' WHEN 7 THEN 'Provide top_k as an integer 1-30; got null.' WHEN 8 THEN 'Provide top_k as an integer 1-30; got ' || (-turn - 1) || '.' WHEN 10 THEN 'Provide queries as strings; got ' || turn || '.'
  WHEN 11 THEN 'Provide arguments as an object; got [' || j || '].' WHEN 12 THEN 'arguments are not valid JSON' WHEN 13 THEN 'Provide at most 8 queries of at most 500 chars; got ' || (9 + turn) || '.' ELSE CASE WHEN q = '' THEN 'Provide at least one non-empty query.' END END AS error FROM c
""")
def search_calls(spark, d):
    """PRJ-02: arguments of search calls, made from the turns of conversations."""
    out = search.search_arguments(_calls(spark, d).withColumn("arguments", _search_text()))
    return out.select("conv_id", "turn", F.array_join(out["queries"], "|").alias("queries"), "top_k", "recency", "error")


def _fetch_text() -> Column:
    url, turn = F.concat(F.lit("https://a.example/"), F.col("conv_id").cast("string")), F.col("turn")
    kinds = [_json(url=url), _json(url=url, part=turn), _json(url=url, part=F.lit(None).cast("int")), _json(url=url, part=turn + 4_294_967_295), _json(url=F.col("q")), _json(url=turn), _json(part=turn), F.to_json(F.array("q")), F.col("q"), _json(url=url, part=F.col("q")), _json(url=url, part=turn + 0.5)]
    return _by_kind([*kinds, kinds[0], kinds[1], kinds[4]])


FETCH_SQL = """
 CASE WHEN n IN (0, 2, 11) THEN 'https://a.example/' || conv_id WHEN n IN (1, 12) AND turn >= 1 THEN 'https://a.example/' || conv_id WHEN n = 3 AND turn = 0 THEN 'https://a.example/' || conv_id WHEN n IN (4, 13) THEN substr(text, 1, 60) END AS url,
 CAST(CASE WHEN n IN (1, 12) AND turn >= 1 THEN turn WHEN n = 3 AND turn = 0 THEN 4294967295 END AS BIGINT) AS part,
 CASE WHEN n IN (1, 12) AND turn < 1 THEN 'invalid part: ' || turn || ' (expected an integer >= 1)' WHEN n = 3 AND turn > 0 THEN 'invalid part: ' || (turn + 4294967295) || ' (expected an integer >= 1)'
  WHEN n = 5 THEN 'invalid url: ' || turn || ' (expected absolute http(s) URL)' WHEN n = 6 THEN 'invalid url:  (expected absolute http(s) URL)' WHEN n = 7 THEN 'invalid url: [' || j || '] (expected absolute http(s) URL)' WHEN n = 8 THEN 'arguments are not valid JSON'
  WHEN n = 9 THEN 'invalid part: ' || j || ' (expected an integer >= 1)' WHEN n = 10 THEN 'invalid part: ' || turn || '.5 (expected an integer >= 1)' END AS error
"""


@query(f"WITH {CALLS_SQL} SELECT conv_id, turn, {FETCH_SQL} FROM c")
def fetch_calls(spark, d):
    """PRJ-03: arguments of fetch calls, made from the turns of conversations."""
    return search.fetch_arguments(_calls(spark, d).withColumn("arguments", _fetch_text())).select("conv_id", "turn", "url", "part", "error")


@query(f"""
WITH {CALLS_SQL}, f AS (SELECT conv_id, turn, n, CASE conv_id % 3 WHEN 0 THEN 'fetch' WHEN 1 THEN 'browse' ELSE q END AS name, conv_id % 3 AS k, {FETCH_SQL} FROM c)
SELECT conv_id, turn, CASE WHEN k = 0 AND error IS NULL THEN 'fetch' END AS route,
 CASE WHEN error = 'arguments are not valid JSON' THEN error WHEN k > 0 THEN 'unknown tool ''' || name || '''' WHEN error IS NOT NULL THEN 'invalid args for ''fetch'': ' || error END AS failure FROM f
""")
def routed_calls(spark, d):
    """ADD-08, ADD-09: calls to their tools, or why not."""
    rows = _calls(spark, d).withColumn("arguments", _fetch_text())
    name = F.when(F.col("conv_id") % 3 == 0, "fetch").when(F.col("conv_id") % 3 == 1, "browse").otherwise(F.trim(F.col("q"), F.lit(" \n")))
    return tools.dispatch(rows.withColumn("name", name).withColumn("id", F.concat_ws("-", "conv_id", "turn"))).select("conv_id", "turn", "route", "failure")


@query("""
WITH r AS (SELECT *, ['search', 'fetch', 'blocked', 'failed', 'already_fetched', 'note'][CAST(1 + event_id % 6 AS INT)] AS kind, CAST(json_extract(props, '$.k') AS INT) % 20 AS page FROM events)
SELECT event_id, kind NOT IN ('blocked', 'failed') AS success, CASE kind WHEN 'blocked' THEN 'search blocked: wall ' || page WHEN 'failed' THEN 'wall ' || page END AS error_text,
 CASE kind WHEN 'blocked' THEN 'execution' WHEN 'failed' THEN CASE WHEN event_id % 4 < 2 THEN 'dispatch' ELSE 'execution' END END AS failure_kind,
 kind = 'fetch' AND row_number() OVER (PARTITION BY user_id, kind = 'fetch', page ORDER BY event_id) = 1 AS first_page FROM r
""")
def result_states(spark, d):
    """ADD-10: success, error and cause of tool results, and which of them hands a run a page for the first time."""
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("search", "fetch", "blocked", "failed", "already_fetched", "note"))), (i % 6 + 1).cast("int"))
    page = (F.get_json_object("props", "$.k").cast("int") % 20).cast("string")
    rows = table(spark, d, "events").select("event_id", "user_id", i.alias("pos"), kind.alias("kind"), F.concat(F.lit("https://www.a.example/"), page, F.when(i % 2 == 0, "#x").otherwise("")).alias("url"), F.concat(F.lit("wall "), page).alias("error"), F.when(i % 4 < 2, "dispatch").otherwise("execution").alias("cause"))
    return tools.result_fields(rows, ["user_id"]).select("event_id", "success", "error_text", "failure_kind", "first_page")
