"""Readers of JSON logs and fixtures: typed, with errors as rows that say where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION_VERSION, RESULTS_FORMAT = 2, 2
EVIDENCE = "struct<source_url:string,collected_at:string,markdown:string,fetch_path:string>"
USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,cached_prompt_tokens:bigint,cache_creation_tokens:bigint,reasoning_tokens:bigint>"
HIT = "struct<title:string,canonical_url:string,display_url:string,snippet:string,providers:array<string>,queries:array<string>,best_rank:bigint,hit_count:bigint,published_date:string>"
KINDS = {
    "header": "session_id string, goal string, size string, started_at string",
    "event": "session_id string, v int, seq bigint, ts string, elapsed_ms bigint, turn int, type string, data variant",
    "turn": f"session_id string, turn int, evidence array<{EVIDENCE}>, synthesis variant, usage {USAGE}, recorded_at string",
    "trace": "session_id string, turn int, phase string, system string, messages_delta array<variant>, messages array<variant>, full boolean, tool_choice variant, reply variant, results array<variant>, recorded_at string",
}
TAPE_SEARCH = f"queries array<string>, outcome string, hits array<{HIT}>, engine_status array<string>, note string, detail string, reason string"
TAPE_PAGES = f"key string, url string, outcome string, evidence {EVIDENCE}, reason string, kind string"
NUGGET = "struct<text:string,scope:string,url:string,volatility:string,verified_on:string>"
GOLDEN = f"category string, goals array<struct<id:string,goal:string,nuggets:array<{NUGGET}>>>"
RUN = "struct<goal_id:string,category:string,repeat:int,exit_code:int,turns_used:int,turn_budget:int,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,cached_prompt_tokens:bigint,citations:int,evidence_urls:int,verification:struct<bullets:int,cited:int,exact:int,partial:int,none:int>,replay_misses:int,wall_ms:bigint,answer:string,error:string,judge:struct<grade:string,nuggets:array<boolean>,nugget_recall:double,core_recall:double,supporting_recall:double,rationale:string>,claims:struct<verdicts:array<string>>>"
RESULTS = f"format int, started_unix bigint, mode string, agent_model string, judge_model string, repeats int, git_rev string, extra_args array<string>, rows array<{RUN}>"
RAW_HIT = "struct<title:string,url:string,snippet:string,provider:string,query:string,rank:bigint,published_date:string>"


#: The place of a row within its task, of Spark's increasing ids.
PLACE = (1 << 33) - 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, in folders below path too, with file and line number, from 1, in byte order.

    A file is read in ranges of bytes by as many tasks as it has ranges. A first pass counts the lines of each range; a
    running sum over the ranges of a file, one small row for each, tells where a range begins, and within a range a task
    reads lines in order. No lines are moved.
    """
    rows = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().bitwiseAND(PLACE).alias("_at"))
    ranges = rows.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("file", "_start", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return rows.join(ranges, ["file", "_start"]).select("value", "file", (F.col("_at") + F.col("_shift")).alias("line"))


def session_rows(spark: SparkSession, path: str, newest: int = SESSION_VERSION) -> DataFrame:
    """Rows of session logs without blank lines: file, line, kind, format_version, value and error (null where the row is good)."""
    rows = lines(spark, path).where(F.trim("value") != "")
    head = F.from_json("value", "kind string, format_version int")
    rows = rows.withColumn("_v", F.try_parse_json("value")).withColumn("_h", head).select("*", "_h.*").drop("_h")
    error = F.when(F.col("_v").isNull(), "not JSON").when(F.col("format_version").isNull(), "no format_version").when(F.col("format_version") > newest, F.format_string("format_version %d is newer than %d", "format_version", F.lit(newest))).when(F.col("kind").isNull(), "no kind").when(~F.col("kind").isin(*KINDS), F.concat(F.lit("unknown kind "), "kind"))
    return rows.withColumn("error", F.when(error.isNotNull(), F.format_string("line %d: %s", "line", error))).drop("_v")


def strict(rows: DataFrame) -> DataFrame:
    """Fails with the first error met instead of passing rows that have one."""
    return rows.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat("file", F.lit(": "), "error"))).otherwise(F.lit(True)))


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    """The good rows of one kind in their own columns; fields that are missing are null."""
    return rows.where((F.col("kind") == kind) & F.col("error").isNull()).select("file", "line", F.from_json("value", KINDS[kind]).alias("r")).select("file", "line", "r.*")


def json_lines(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    return spark.read.schema(schema).option("mode", mode).option("recursiveFileLookup", True).json(path)


def tape_searches(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, TAPE_SEARCH)


def tape_pages(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, TAPE_PAGES)


def recorded_pages(spark: SparkSession, path: str) -> DataFrame:
    """Evidence of pages, with file and line; outcomes other than pages are left out."""
    rows = lines(spark, path).where(F.trim("value") != "").withColumn("r", F.from_json("value", TAPE_PAGES))
    return rows.where("r.outcome = 'page' AND r.evidence IS NOT NULL").select("file", "line", "r.key", "r.url", "r.evidence.*")


def results(spark: SparkSession, path: str, expected: int = RESULTS_FORMAT) -> DataFrame:
    """Run rows of results files; fails for another format."""
    files = spark.read.schema(RESULTS).option("multiLine", True).json(path)
    checked = files.where(F.when(F.coalesce("format", F.lit(-1)) != expected, F.raise_error(F.format_string("results format %d, expected %d", F.coalesce("format", F.lit(-1)), F.lit(expected)))).otherwise(F.lit(True)))
    return checked.select("mode", "agent_model", "judge_model", F.explode("rows").alias("r")).select("mode", "agent_model", "judge_model", "r.*")


def golden(spark: SparkSession, path: str) -> DataFrame:
    """A row for each nugget: category, goal_id, goal, pos and its fields; category_ok says whether the file is named after it."""
    files = spark.read.schema(GOLDEN).option("multiLine", True).json(path).withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json(?:\.gz)?$", 1))
    goals = files.select("category", (F.col("category") == F.col("name")).alias("category_ok"), F.explode("goals").alias("g"))
    return goals.select("category", "category_ok", F.col("g.id").alias("goal_id"), "g.goal", F.posexplode("g.nuggets").alias("pos", "n")).select("category", "category_ok", "goal_id", "goal", "pos", "n.*")


def unknown_fields(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """Top-level fields of JSON files that a schema would silently leave out."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.explode(F.json_object_keys("value")).alias("field")).where(~F.col("field").isin(allowed))


def cache_entries(spark: SparkSession, path: str) -> DataFrame:
    """Cache files: key from the file's name, fetched_at_secs and results; corrupt files are misses."""
    schema = f"fetched_at_secs bigint, results array<{RAW_HIT}>, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("key"), "fetched_at_secs", "results", (F.col("_corrupt").isNotNull() | F.col("fetched_at_secs").isNull()).alias("miss"))


def engine_states(spark: SparkSession, path: str) -> DataFrame:
    """engine and state of a state file; none for a corrupt one."""
    state = "struct<suspended_until_ms:bigint,suspended_at_ms:bigint,suspend_reason:string,last_request_ms:bigint,last_success_ms:bigint>"
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{state}>")).alias("engine", "s")).select("engine", "s.*")


def crate_index(spark: SparkSession, path: str) -> DataFrame:
    """Index lines in order; lines that are not JSON are left out."""
    rows = lines(spark, path).withColumn("r", F.from_json("value", "vers string, yanked boolean, rust_version string, pubtime string"))
    return rows.where("r.vers IS NOT NULL").select("file", F.col("line").alias("ord"), "r.vers", F.coalesce("r.yanked", F.lit(False)).alias("yanked"), "r.rust_version", F.substring("r.pubtime", 1, 10).alias("published"))


def crate_search(bodies: DataFrame, most: int = 20) -> DataFrame:
    """bodies (leg, body) of the registry's search as rows: name, version (default, else largest), description."""
    from ..functions import text as T
    from ..functions import urls as U

    row = "struct<name:string,default_version:string,max_version:string,description:string>"
    rows = bodies.select("leg", F.posexplode(F.from_json("body", f"crates array<{row}>")["crates"]).alias("at", "c")).withColumn("version", F.coalesce("c.default_version", "c.max_version"))
    rows = rows.where(U.is_crate_name(F.col("c.name")) & F.col("version").isNotNull())
    n = F.row_number().over(Window.partitionBy("leg").orderBy("at"))
    return rows.withColumn("pos", n - 1).where(F.col("pos") < most).select("leg", "pos", "c.name", "version", T.collapse(F.coalesce("c.description", F.lit(""))).alias("description"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Gateway exchanges."""
    return json_lines(spark, path, "path string, model string, request_bytes bigint, status int, body string")


def http_frames(raw: DataFrame) -> DataFrame:
    """raw (message) requests: head and body split at the blank line, content length, model and whether the body is whole."""
    head, body = F.substring_index("message", "\r\n\r\n", 1), F.expr("substring(message, length(substring_index(message, '\r\n\r\n', 1)) + 5)")
    length = F.regexp_extract(head, r"(?im)^content-length:\s*(\d+)", 1).try_cast("bigint")
    return raw.select("*", head.alias("head"), body.alias("body"), length.alias("content_length"), F.try_variant_get(F.try_parse_json(body), "$.model", "string").alias("model"), (F.octet_length(body) >= F.coalesce(length, F.lit(0))).alias("whole"))
