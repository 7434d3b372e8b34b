"""Search legs: planning, routing, classifying recorded responses, reports."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import ALIASES, BUILTIN_ROOTS, CAN_LIMIT, DEFAULT_ENGINES, DEFAULT_TOP_K, ENGINES, ERROR_STATUS, FILLERS, MAX_QUERIES, MAX_QUERY_CHARS, MAX_TOP_K, PRIORITY, RECENCY
from ..functions.lazy import arrow

CRATE_WORDS = ["rust", "crate", "crates", "cargo", "crates.io"]


def engines(spark) -> DataFrame:
    """Engines with priority, weight, page limit, requests in flight, gaps and request cap."""
    rows = [(name, *x) for name, x in ENGINES.items()]
    return spark.createDataFrame(rows, "engine string, priority int, weight double, max_pages int, concurrency int, gap_min_ms int, gap_max_ms int, request_cap int")


def valid_search(calls: DataFrame) -> DataFrame:
    """calls (queries array, top_k) with trimmed queries, top_k in range, error (null, empty_query or too_many_queries) and, of the last, got and max: queries, or characters of one."""
    kept = F.filter(F.transform("queries", lambda q: F.regexp_replace(q, r"(?U)^\s+|\s+$", "")), lambda q: q != "")
    out = calls.withColumn("queries", kept)
    long = F.get(F.filter(F.transform("queries", lambda q: F.char_length(q)), lambda n: n > MAX_QUERY_CHARS), F.lit(0))
    many = F.size("queries") > MAX_QUERIES
    error = F.when(F.size("queries") == 0, "empty_query").when(many | long.isNotNull(), "too_many_queries")
    out = out.withColumn("got", F.when(many, F.size("queries")).otherwise(long)).withColumn("max", F.when(many, MAX_QUERIES).when(long.isNotNull(), MAX_QUERY_CHARS))
    return out.withColumn("top_k", F.greatest(F.lit(1), F.least(F.lit(MAX_TOP_K), F.coalesce("top_k", F.lit(DEFAULT_TOP_K))))).withColumn("error", error)


NOT_JSON = "arguments are not valid JSON"


class _Refused(Exception):
    """Arguments that a tool does not take."""


def _compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _no_constant(name: str):
    raise ValueError(name)


def _loaded(text: str | None):
    try:
        return json.loads(text or "", parse_constant=_no_constant)
    except (ValueError, RecursionError):
        raise _Refused(NOT_JSON) from None


def _whole(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and 0 <= value < 1 << 64


def _search_call(args) -> tuple[list[str], int, str | None]:
    if not isinstance(args, dict):
        raise _Refused(f"Provide arguments as an object; got {_compact(args)}.")
    if extra := sorted(set(args) - {"queries", "top_k", "recency"}):
        raise _Refused(f"Unknown argument `{extra[0]}`; allowed: queries, top_k, recency.")
    if "queries" not in args:
        raise _Refused(f"Provide queries as an array of 1-{MAX_QUERIES} strings; got missing.")
    queries, top_k, recency = args["queries"], args.get("top_k"), args.get("recency")
    if isinstance(queries, str):  # sometimes the array comes as text
        try:
            inner = json.loads(queries, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            inner = None
        if not isinstance(inner, list) or not all(isinstance(q, str) for q in inner):
            raise _Refused(f"Provide queries as an array of strings; got {_compact(queries)}.")
        queries = inner
    if not isinstance(queries, list):
        raise _Refused(f"Provide queries as an array of strings; got {_compact(queries)}.")
    for q in queries:
        if not isinstance(q, str):
            raise _Refused(f"Provide queries as strings; got {_compact(q)}.")
    if "top_k" in args and not _whole(top_k):
        raise _Refused(f"Provide top_k as an integer 1-{MAX_TOP_K}; got {_compact(top_k)}.")
    if recency is not None and (not isinstance(recency, str) or recency not in RECENCY):
        raise _Refused(f"Provide recency as {'|'.join(RECENCY)}; got {_compact(recency)}.")
    kept = [q.strip() for q in queries if q.strip()]
    if not kept:
        raise _Refused("Provide at least one non-empty query.")
    for got, most in ((len(kept), MAX_QUERIES), *((len(q), MAX_QUERY_CHARS) for q in kept)):
        if got > most:
            raise _Refused(f"Provide at most {most} queries of at most {MAX_QUERY_CHARS} chars; got {got}.")
    return kept, min(max(DEFAULT_TOP_K if top_k is None else top_k, 1), MAX_TOP_K), recency


def _fetch_call(args) -> tuple[str, int | None]:
    url = args.get("url") if isinstance(args, dict) else args
    if not isinstance(args, dict) or not isinstance(url, str):
        input_ = "" if isinstance(args, dict) and "url" not in args else _compact(url)
        raise _Refused(f"invalid url: {input_} (expected absolute http(s) URL)")
    part = args.get("part")
    if part is not None and not (_whole(part) and 1 <= part < 1 << 32):
        raise _Refused(f"invalid part: {_compact(part)} (expected an integer >= 1)")
    return url, part


def _checked(rule, width: int):
    def check(arguments: pa.Array) -> list[tuple]:
        out = []
        for text in arguments.to_pylist():
            try:
                out.append((*rule(_loaded(text)), None))
            except _Refused as e:
                out.append((*[None] * width, str(e)))
        return out

    return check


@arrow("struct<queries:array<string>,top_k:int,recency:string,error:string>")
def _search_calls(arguments: pa.Array) -> pa.Array:
    rows = _checked(_search_call, 3)(arguments)
    kind = pa.struct([("queries", pa.list_(pa.string())), ("top_k", pa.int32()), ("recency", pa.string()), ("error", pa.string())])
    return pa.array([dict(zip(("queries", "top_k", "recency", "error"), r, strict=True)) for r in rows], kind)


@arrow("struct<url:string,part:bigint,error:string>")
def _fetch_calls(arguments: pa.Array) -> pa.Array:
    rows = _checked(_fetch_call, 2)(arguments)
    return pa.array([dict(zip(("url", "part", "error"), r, strict=True)) for r in rows], pa.struct([("url", pa.string()), ("part", pa.int64()), ("error", pa.string())]))


def search_arguments(calls: DataFrame, column: str = "arguments") -> DataFrame:
    """Tool arguments as JSON text -> queries (trimmed), top_k (in range), recency and error.

    queries may be an array of strings or such an array as text. A wrong value of any kind is an error that shows it;
    then the other columns are null.
    """
    return calls.withColumn("_c", _search_calls(F.col(column))).select(*calls.columns, "_c.*")


def search_arguments_error(arguments: Column) -> Column:
    return _search_calls(arguments)["error"]


def fetch_arguments_error(arguments: Column) -> Column:
    return _fetch_calls(arguments)["error"]


def fetch_arguments(calls: DataFrame, column: str = "arguments") -> DataFrame:
    """Tool arguments as JSON text -> url, part (null: none given) and error. Whether the URL is one is seen when it is fetched."""
    return calls.withColumn("_c", _fetch_calls(F.col(column))).select(*calls.columns, "_c.*")


def enabled_engines(setting: Column) -> Column:
    """A comma list of names and aliases as engine ids by priority; without a known name the default ones."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    ids = F.filter(F.transform(F.split(F.coalesce(setting, F.lit("")), ","), lambda t: F.try_element_at(names, F.lower(F.trim(t)))), lambda t: t.isNotNull())
    order = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    ranked = F.transform(F.array_sort(F.transform(F.array_distinct(ids), lambda e: F.struct(F.element_at(order, e).alias("p"), e.alias("e")))), lambda x: x["e"])
    return F.when(F.size(ids) == 0, F.array(*[F.lit(e) for e in DEFAULT_ENGINES])).otherwise(ranked)


def can_limit(engine: Column, recency: Column) -> Column:
    """Whether an engine can apply a recency code; without one every engine can."""
    out = recency.isNull()
    for name, codes in CAN_LIMIT.items():
        out = out | ((engine == name) & recency.isin(codes))
    return out


def crate_route(query: Column) -> Column:
    """struct(term, exact) if a query is about a package of the registry, else null."""
    name = r"^[A-Za-z][A-Za-z0-9_-]{0,63}$"
    low_name = r"^[a-z][a-z0-9_-]{0,63}$"
    spans = F.filter(F.split(query, "`"), lambda s, i: (i % 2 == 1) & s.rlike(low_name))
    tokens = F.transform(F.filter(F.split(query, T.SPACE), lambda t: t != ""), lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9:_-]+|[^A-Za-z0-9:_-]+$", ""))
    plain = lambda t: F.regexp_replace(F.lower(t), "'s$", "")
    paths = F.filter(tokens, lambda t: F.contains(t, F.lit("::")))
    roots = F.filter(F.transform(paths, lambda t: F.substring_index(t, "::", 1)), lambda r: r.rlike(name) & ~r.isin(BUILTIN_ROOTS))
    usable = lambda t: t.isNotNull() & t.rlike(name) & ~plain(t).isin(CRATE_WORDS) & ~F.lower(t).isin(FILLERS)
    beside = F.flatten(F.transform(tokens, lambda t, i: F.when(plain(t).isin("crate", "crates"), F.array(F.when(i > 0, F.get(tokens, i - 1)), F.get(tokens, i + 1))).otherwise(F.array().cast("array<string>"))))
    beside = F.filter(beside, usable)
    only = F.get(tokens, F.lit(0))
    alone = (F.size(tokens) == 1) & only.rlike(low_name) & only.rlike("[-_]")
    rest = F.array_join(F.filter(tokens, lambda t: (t != "") & ~plain(t).isin(CRATE_WORDS) & ~F.lower(t).isin(FILLERS)), " ")
    keyword = (F.size(paths) == 0) & F.exists(tokens, lambda t: plain(t).isin(CRATE_WORDS)) & (rest != "")
    exact = F.coalesce(F.get(spans, F.lit(0)), F.get(roots, F.lit(0)), F.get(beside, F.lit(0)), F.when(alone, only))
    return F.when(exact.isNotNull(), F.struct(exact.alias("term"), F.lit(True).alias("exact"))).when(keyword, F.struct(rest.alias("term"), F.lit(False).alias("exact")))


def crate_rows(rows: DataFrame, leg: list[str], keep: int = 3) -> DataFrame:
    """Registry rows (pos, name) of a routed leg (term, exact): the named one for an exact route that has it, else the first."""
    fold = lambda c: F.translate(F.lower(c), "_", "-")
    named = F.col("exact") & (fold("name") == fold("term"))
    order = Window.partitionBy(*leg).orderBy("pos")
    out = rows.withColumn("_hit", F.min(F.when(named, F.col("pos"))).over(Window.partitionBy(*leg))).withColumn("_n", F.row_number().over(order))
    return out.where(F.when(F.col("_hit").isNotNull(), F.col("pos") == F.col("_hit")).otherwise(F.col("_n") <= keep)).drop("_hit", "_n")


def plan_legs(calls: DataFrame, engine_table: DataFrame, query_cap: int = 4) -> DataFrame:
    """calls (call_id, queries, recency, engines) -> a row for each leg: query_index, query, engine, ordinal and capped.

    The small engine table is looked up by the exploded engine name; there is no product of tables.
    """
    legs = calls.select("call_id", "recency", F.explode("engines").alias("engine"), "queries").select("call_id", "recency", "engine", F.posexplode("queries").alias("query_index", "query"))
    legs = legs.where(can_limit(F.col("engine"), F.col("recency"))).where((F.col("engine") != "cratesio") | crate_route(F.col("query")).isNotNull())
    window = Window.partitionBy("call_id", "engine").orderBy("query_index")
    legs = legs.join(F.broadcast(engine_table.select("engine", "priority")), "engine")  # a fixed table of engines
    return legs.withColumn("ordinal", F.row_number().over(window) - 1).withColumn("capped", F.col("ordinal") >= query_cap)


def _has(text: str, *marks: str) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(F.coalesce(text, F.lit("")), F.lit(m))
    return out


def walled() -> Column:
    """Whether a recorded response (provider, body, final_url) is a wall against bots."""
    body, url, p = F.col("body"), F.col("final_url"), F.col("provider")
    start = _has(url, "/en/errors/", "/sp/captcha", "/sp/cdn/error-pages/blocked") | _has(body, "component---src-pages-captcha", 'id="anubis_challenge"', "/.within.website/x/cmd/anubis/")
    return (
        F.when(p == "duckduckgo", _has(body, "anomaly-modal", "anomaly.js"))
        .when(p == "bing", _has(body, "challenge/verify", "captchaSuccessPostMessage"))
        .when(p == "yahoo", _has(url, "guce.yahoo.com", "consent.yahoo.com"))
        .when(p == "startpage", start)
        .otherwise(F.lit(False))
    )


def recognised() -> Column:
    """Whether a body is a result page of its provider, with or without rows."""
    body, p = F.col("body"), F.col("provider")
    return (
        F.when(p == "duckduckgo", _has(body, 'id="links"', "no-results", "result--no-result"))
        .when(p == "bing", _has(body, 'id="b_results"'))
        .when(p == "brave", _has(body, 'id="results"'))
        .when(p == "yahoo", _has(body, 'id="results"') & ~_has(body, "zrpmsg", "zrp_yst"))
        .when(p == "startpage", _has(body, "w-gl", "did not match any"))
        .otherwise(F.lit(True))
    )


def classify(responses: DataFrame) -> DataFrame:
    """responses (provider, status, body, final_url, n_rows) with error: null, challenge or upstream, and detail."""
    limited = F.col("provider").isin("bing", "brave") & (F.col("status") == 429)
    odd = ~F.col("status").between(200, 299)
    drift = (F.col("n_rows") == 0) & ~recognised()
    error = F.when(walled() | limited, "challenge").when(odd | drift, "upstream")
    detail = F.when(walled() | limited, "bot challenge").when(odd, F.format_string("HTTP %d", "status")).when(drift, "unrecognized markup")
    return responses.withColumn("error", error).withColumn("detail", detail)


def transport_error(timed_out: Column, detail: Column) -> Column:
    """A request without a response: a timeout before anything else, else upstream without a status."""
    return F.struct(F.when(timed_out, "timeout").otherwise("upstream").alias("kind"), F.when(timed_out, F.lit(None)).otherwise(detail).alias("detail"), F.lit(None).cast("int").alias("status"))


def error_status(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ERROR_STATUS.items() for x in pair]), kind)


def error_provider(kind: Column, provider: Column) -> Column:
    """The engine an error belongs to; errors of a whole call have none."""
    return F.when(~kind.isin("empty_query", "too_many_queries", "all_failed"), provider)


def problem_text(kind: Column, detail: Column, remaining: Column, reason: Column, query: Column | None = None) -> Column:
    """What went wrong with a leg; a timeout names its query, or none in the line of an engine. detail of too many queries: how many there are and may be, as "9 > 8"."""
    return (
        F.when(kind == "suspended", F.concat(F.lit("suspended ("), reason, F.lit("), "), remaining.cast("string"), F.lit("s left")))
        .when(kind == "timeout", F.lit("timed out") if query is None else F.concat(F.lit("timed out: "), query))
        .when(kind == "empty_query", "empty query")
        .when(kind == "too_many_queries", F.concat(F.lit("too many queries: "), detail))
        .otherwise(F.coalesce(detail, kind))
    )


def engine_report(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """outcomes (engine, leg, n_rows, answered, cached, problem, detail if known) -> rows, legs answered and cached, problems and details in first-seen order, status."""
    listed = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), F.struct("leg", c)))), lambda x: x[c]))
    detail = F.coalesce("detail", "problem") if "detail" in outcomes.columns else F.col("problem")
    outcomes, problems = outcomes.withColumn("detail", detail), listed("problem")
    out = outcomes.groupBy(*by, "engine").agg(
        F.sum("n_rows").alias("rows"), F.count_if("answered").alias("answered_legs"), F.count_if(F.col("answered") & F.col("cached")).alias("cached_legs"), problems.alias("problems"), listed("detail").alias("details")
    )
    status = F.when(F.col("rows") > 0, "rows").when(F.col("answered_legs") > 0, "no_results").otherwise(F.coalesce(F.get("problems", F.lit(0)), F.lit("error")))
    return out.withColumn("status", status)


def status_line(report: DataFrame, by: list[str]) -> DataFrame:
    """lines of each call, one for each engine in priority order: rows or no results if it answered, then its distinct problems."""
    rows = F.when(F.col("rows") == 0, "no results").otherwise(T.plural(F.col("rows"), "row", "rows"))
    parts = F.concat(F.when(F.col("answered_legs") > 0, F.array(rows)).otherwise(F.array().cast("array<string>")), "details")
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p]), F.col("engine")), F.lit(99))
    cell = F.struct(place.alias("p"), "engine", F.concat("engine", F.lit(": "), F.array_join(parts, ", ")).alias("line"))
    return report.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["line"]).alias("lines"))


def failures(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """For calls of which every leg failed: engines in first-seen order with their distinct messages, and whether all were walls."""
    one = outcomes.groupBy(*by, "engine").agg(F.min("leg").alias("leg"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("leg", "message"))), lambda x: x["message"])).alias("m"), F.bool_and(~F.col("answered")).alias("failed"), F.bool_and((F.col("problem") == "challenge") | ((F.col("problem") == "suspended") & (F.col("reason") == "challenge"))).alias("wall"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("leg", "engine", "m"))), lambda x: F.concat(x["engine"], F.lit(": "), F.array_join(x["m"], " / ")))
    return one.groupBy(*by).agg(F.bool_and("failed").alias("failed"), F.bool_and("wall").alias("all_challenged"), F.array_join(listed, "; ").alias("failures")).where("failed").drop("failed")


def search_stats(outcomes: DataFrame, merged: DataFrame, by: list[str]) -> DataFrame:
    """Queries, legs, raw hits, and merged hits before the cut of each call."""
    legs = outcomes.groupBy(*by).agg(F.countDistinct("query_index").alias("queries"), F.count("*").alias("legs"), F.sum("n_rows").alias("raw_hits"))
    return legs.join(merged.groupBy(*by).agg(F.count("*").alias("merged")), by, "left").withColumn("merged", F.coalesce("merged", F.lit(0)))


def deadlines(legs: DataFrame, soft_ms: int = 5000, hard_ms: int = 30000) -> DataFrame:
    """legs (call_id, started_ms, ended_ms, ok) -> outcome (done or timeout) and queued: cut before it was sent.

    From the soft limit on, as soon as any leg has succeeded, legs still queued are cut; they have sent nothing, and
    report a timeout like those that the hard limit ends. Legs that have started go on to the hard limit.
    """
    first_ok = F.min(F.when(F.col("ok"), F.col("ended_ms"))).over(Window.partitionBy("call_id"))
    cut = F.least(F.greatest(F.lit(soft_ms), F.coalesce(first_ok, F.lit(hard_ms))), F.lit(hard_ms))
    out = legs.withColumn("cut_ms", cut)
    out = out.withColumn("queued", F.col("started_ms").isNull() | (F.col("started_ms") > F.col("cut_ms")))
    return out.withColumn("outcome", F.when(~F.col("queued") & (F.col("ended_ms") <= hard_ms), "done").otherwise("timeout"))


def stop_pages(pages: DataFrame, leg: list[str], limit: int = 5, first: int = 10, later: int = 7, cap: int = 20) -> DataFrame:
    """Recorded pages (page, token, n_rows) that a paged leg would have asked for: until enough rows, the limit, a short page, or a missing or repeated token."""
    order = Window.partitionBy(*leg).orderBy("page")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    short = F.col("n_rows") < F.when(F.col("page") == 0, first).otherwise(later)
    ends = short | F.col("token").isNull() | F.coalesce(F.col("token") == F.lag("token").over(order), F.lit(False))
    out = pages.withColumn("_ends", ends)
    stopped = F.coalesce(F.max(F.col("_ends").cast("int")).over(before), F.lit(0)) == 1
    return out.withColumn("_stop", stopped).withColumn("_have", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).where(~F.col("_stop") & (F.col("_have") < cap) & (F.col("page") < limit)).drop("_ends", "_stop", "_have")
