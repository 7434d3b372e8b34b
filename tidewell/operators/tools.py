"""Tool calls, messages, payloads and settings around a model's turns, as projections."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.lazy import arrow
from .history import turns_left
from .search import NOT_JSON, fetch_arguments_error, search_arguments_error

#: JSON schemas of the two tools.
SCHEMAS = {
    "search": {"type": "object", "additionalProperties": False, "required": ["queries"], "properties": {"queries": {"type": "array", "items": {"type": "string", "maxLength": 500}, "minItems": 1, "maxItems": 8}, "top_k": {"type": "integer", "minimum": 1, "maximum": 30}, "recency": {"type": "string", "enum": ["day", "week", "month", "year"]}}},
    "fetch": {"type": "object", "additionalProperties": False, "required": ["url"], "properties": {"url": {"type": "string"}, "part": {"type": "integer", "minimum": 1}}},
}


def dispatch(calls: DataFrame) -> DataFrame:
    """calls (id, name, arguments) with route (search, fetch or null) and failure: arguments that are not JSON, an unknown tool, or arguments that it does not take."""
    out = calls.withColumn("_s", search_arguments_error(F.col("arguments"))).withColumn("_f", fetch_arguments_error(F.col("arguments")))
    error = F.when(F.col("name") == "search", F.col("_s")).when(F.col("name") == "fetch", F.col("_f"))
    bad = F.when(error.isNotNull(), F.concat(F.lit("invalid args for '"), "name", F.lit("': "), error))
    unread = F.col("_f") == NOT_JSON
    failure = F.when(unread, NOT_JSON).when(~F.coalesce(F.col("name").isin(*SCHEMAS), F.lit(False)), F.concat(F.lit("unknown tool '"), F.coalesce("name", F.lit("")), F.lit("'"))).otherwise(bad)
    return out.withColumn("failure", failure).withColumn("route", F.when(failure.isNull(), F.col("name"))).drop("_s", "_f")


def allowed_tools(tools: Column, allowed: Column) -> Column:
    """Of the tools (name, purpose), in their order, those that are allowed."""
    return F.filter(tools, lambda t: F.array_contains(allowed, t["name"]))


def repair_note(tools: Column, allowed: Column, left: Column) -> Column:
    """What a model is told that replied with neither a call nor an answer; on the last turns it has no tools to choose from."""
    note = turns_left(left, F.lit(0))
    roster = F.array_join(F.transform(allowed_tools(tools, allowed), lambda t: F.concat(t["name"], F.lit(" — "), t["purpose"])), "\n")
    empty = F.lit("Your last reply had no tool call and no answer text.")
    more = F.concat(F.lit(" Continue the research with a tool call, or reply with the final answer inside <answer></answer> tags.\nAvailable tools:\n"), roster)
    return F.concat(empty, F.when(left <= 1, "").otherwise(more), note)


def result_fields(results: DataFrame, by: list[str]) -> DataFrame:
    """results (pos, kind, url, error, cause: dispatch or execution) of runs (by) with success, error_text, failure_kind and first_page.

    A blocked search has been carried out, so it fails as execution; a failed call keeps its own cause. first_page: the
    first time that a run is handed a page, by its URL key.
    """
    ok = F.col("kind").isin("search", "note", "fetch", "already_fetched")
    blocked = F.col("kind") == "blocked"
    text = F.when(blocked, F.concat(F.lit("search blocked: "), F.coalesce("error", F.lit("")))).when(~ok, F.coalesce("error", F.lit("")))
    cause = F.when(blocked, "execution").when(~ok, F.col("cause"))
    page = F.when(F.col("kind") == "fetch", U.url_key(F.col("url")))
    first = page.isNotNull() & (F.row_number().over(Window.partitionBy(*by, "_page").orderBy("pos")) == 1)
    out = results.withColumn("success", ok).withColumn("error_text", text).withColumn("failure_kind", cause).withColumn("_page", page)
    return out.withColumn("first_page", first).drop("_page")


def message(role: str, content: Column, **more: Column) -> Column:
    """A chat message and its size in characters."""
    return F.struct(F.lit(role).alias("role"), content.alias("content"), *[c.alias(k) for k, c in more.items()], F.char_length(content).alias("chars"))


def goal_message(goal: Column, size: Column) -> Column:
    return F.concat(F.lit("Research goal: "), goal, F.lit("\nRequested synthesis size: "), size, F.lit("."))


def system_prompt(template: str, values: dict[str, Column]) -> Column:
    """A template with {names} filled in."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def call_json(calls: Column) -> Column:
    """Tool calls (id, name, arguments) in the form of the wire."""
    return F.to_json(F.transform(calls, lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function"))))


def parsed_arguments(arguments: Column) -> Column:
    """Arguments as a variant; none given count as an empty object; null for text that is not JSON."""
    return F.try_parse_json(F.when(F.trim(arguments) == "", "{}").otherwise(arguments))


def trace_results(results: DataFrame, by: list[str]) -> DataFrame:
    """Tool results (i, tool_call_id, text) of a turn as the JSON of one trace row."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("i", "tool_call_id", "text"))), lambda r: F.struct(r["tool_call_id"].alias("tool_call_id"), r["text"].alias("content")))
    return results.groupBy(*by).agg(F.to_json(each).alias("results"))


def search_payload(rows: DataFrame) -> DataFrame:
    """rows (queries, hits, engines array of (engine, answered, cached, ...)) with data: the event's payload as JSON. cached: every answer came from the cache."""
    legs = F.filter("engines", lambda e: e["answered"])
    cached = (F.size(legs) > 0) & F.forall(legs, lambda e: e["cached"])
    return rows.withColumn("data", F.to_json(F.struct("queries", "hits", "engines", cached.alias("cached"))))


def fetch_payload(rows: DataFrame) -> DataFrame:
    return rows.withColumn("data", F.to_json(F.struct("url", "part", "parts", "chars", "error")))


def public_hits(hits: DataFrame) -> DataFrame:
    """The fields of a merged hit that callers see, absent ones with their defaults."""
    return hits.select("title", F.col("display_url").alias("url"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("providers", F.array().cast("array<string>")).alias("providers"), F.coalesce("queries", F.array().cast("array<string>")).alias("queries"), "published_date")


def replayed_turns(events: DataFrame, by: str = "session_id") -> DataFrame:
    """Events (seq, type, turn, data) as turns: the tools called, repairs, tokens, and how the session ended.

    final: the loop told the model that the turn was its last (turn.started says so). outcome: on the last turn that there
    is; interrupted if the session never finished.
    """
    of = lambda t: F.count_if(F.col("type") == t)
    told = F.coalesce(F.bool_or((F.col("type") == "turn.started") & (F.get_json_object("data", "$.final_turn") == "true")), F.lit(False))
    turns = events.where("turn IS NOT NULL").groupBy(by, "turn").agg(F.min("seq").alias("first_seq"), of("search.started").alias("searches"), of("fetch.started").alias("fetches"), of("model.retry").alias("retries"), of("answer.verified").alias("answers"), told.alias("final"))
    end = events.where("type = 'session.finished'").groupBy(by).agg(F.max_by(F.get_json_object("data", "$.outcome"), "seq").alias("outcome"))
    last = F.max("turn").over(Window.partitionBy(by))
    return turns.withColumn("_last", F.col("turn") == last).join(end, by, "left").withColumn("outcome", F.when(F.col("_last"), F.coalesce("outcome", F.lit("interrupted")))).drop("_last")


def _letters(value) -> int:
    total, stack = 0, [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            total += len(x)
        elif isinstance(x, dict):
            stack += x.values()
        elif isinstance(x, list):
            stack += x
    return total


@arrow("bigint")
def string_chars(text: pa.Array) -> pa.Array:
    """Characters of all string values in a JSON tree; null for text that is not JSON."""

    def count(t: str | None) -> int | None:
        try:
            return None if t is None else _letters(json.loads(t))
        except ValueError:
            return None

    return pa.array([count(t) for t in text.to_pylist()], pa.int64())


def setting_problems(settings: DataFrame) -> DataFrame:
    """settings (max_tokens, thinking_budget, max_attempts, timeout_ms, base_url, format) with problem; null for good ones."""
    positive = F.least("max_tokens", "max_attempts", "timeout_ms") > 0
    problem = (
        F.when(~F.coalesce(positive, F.lit(False)), "numbers must be positive")
        .when(~F.col("format").isin("openai", "anthropic"), F.concat(F.lit("unknown format "), "format"))
        .when(F.coalesce("thinking_budget", F.lit(0)) >= F.col("max_tokens"), "max_tokens must exceed thinking_budget")
        .when((F.col("format") == "anthropic") & F.col("thinking_budget").between(1, 1023), "thinking_budget must be at least 1024")
        .when(~F.col("base_url").rlike("^https?://[^/ ]+"), "base_url must be an http URL")
    )
    return settings.withColumn("problem", problem)


def root_folder(*candidates: Column) -> Column:
    """The first that is set and not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def session_id_ok(name: Column) -> Column:
    return name.rlike(r"^(?!\.)[A-Za-z0-9._-]{1,64}$")
