"""Model replies: event streams to deltas, deltas to replies, single bodies, usage, request bodies, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_event_stream(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))) == "text/event-stream"


def sse_events(body: Column) -> Column:
    """Array of the data of each event in a body: data lines joined by newlines, an event ending at a blank line.

    Comments and other fields are left out, one space after the colon too, and an event that the body cuts off.
    """
    blocks = F.split(F.regexp_replace(body, "\r\n", "\n"), "\n\n", -1)
    closed = F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0)))
    lines = lambda b: F.filter(F.split(b, "\n"), lambda x: x.startswith("data:") | (x == "data"))
    data = F.transform(closed, lambda b: F.when(F.size(lines(b)) > 0, F.array_join(F.transform(lines(b), lambda x: F.regexp_replace(x, "^data:? ?", "")), "\n")))
    return F.filter(data, lambda x: x.isNotNull())


def joined_stream(chunks: DataFrame, by: str = "stream_id") -> DataFrame:
    """chunks (chunk_seq, chunk binary) -> the body of each stream, cut anywhere."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", F.hex("chunk").alias("h")))), lambda x: x["h"])
    return chunks.groupBy(by).agg(F.unhex(F.array_join(parts, "")).cast("string").alias("body"))


def openai_replies(events: DataFrame, by: str = "stream_id") -> DataFrame:
    """events (seq, data) of chat streams -> thinking, output, refusal, tool_calls, finish_reason, usage and whether the stream was cut."""
    call = "struct<index:int,id:string,function:struct<name:string,arguments:string>>"
    schema = f"choices array<struct<delta struct<content:string,reasoning_content:string,refusal:string,tool_calls:array<{call}>>,finish_reason:string>>, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>, error struct<message:string>".replace("delta struct", "delta:struct")
    rows = events.withColumn("done", F.trim("data") == "[DONE]").withColumn("j", F.from_json("data", schema)).withColumn("c", F.get("j.choices", F.lit(0)))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("t"))))), lambda x: x["t"]), "")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    out = rows.groupBy(by).agg(text("c.delta.content").alias("output"), text("c.delta.reasoning_content").alias("thinking"), F.nullif(text("c.delta.refusal"), F.lit("")).alias("refusal"), last("c.finish_reason").alias("finish_reason"), last("j.usage").alias("usage"), last("j.error").alias("error"), (~F.bool_or("done") & (F.count("c.finish_reason") == 0)).alias("cut"))
    each = rows.select(by, "seq", F.explode("c.delta.tool_calls").alias("t")).groupBy(by, "t.index")
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("seq")))
    calls = each.agg(first("t.id").alias("id"), first("t.function.name").alias("name"), text("t.function.arguments").alias("arguments"))
    calls = calls.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("index", "id", "name", "arguments"))).alias("tool_calls"))
    return out.join(calls, by, "left")


def anthropic_replies(events: DataFrame, by: str = "stream_id") -> DataFrame:
    """events (seq, data) of message streams -> thinking, output, tool_calls, finish_reason, usage (counts never fall) and cut."""
    block = "struct<type:string,id:string,name:string,text:string>"
    delta = "struct<type:string,text:string,thinking:string,partial_json:string,stop_reason:string>"
    usage = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"
    schema = f"type string, index int, content_block {block}, delta {delta}, usage {usage}, message struct<usage:{usage}>, error struct<message:string>"
    rows = events.withColumn("j", F.from_json("data", schema)).select(by, "seq", "j.*")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("seq", c.alias("t"))))), lambda x: x["t"]), "")
    blocks = rows.where("index IS NOT NULL").groupBy(by, "index").agg(
        F.max("content_block.type").alias("kind"), F.max("content_block.id").alias("id"), F.max("content_block.name").alias("name"), F.concat(F.coalesce(F.max("content_block.text"), F.lit("")), text(F.col("delta.text"))).alias("text"), text(F.col("delta.thinking")).alias("thinking"), text(F.col("delta.partial_json")).alias("arguments")
    )
    listed = lambda k, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("index", F.col(c).alias("t"))))), lambda x: x["t"]), "")
    content = blocks.groupBy(by).agg(listed("text", "text").alias("output"), listed("thinking", "thinking").alias("thinking"), F.array_sort(F.collect_list(F.when(F.col("kind") == "tool_use", F.struct("index", "id", "name", "arguments")))).alias("tool_calls"))
    most = lambda c: F.greatest(F.max(f"usage.{c}"), F.max(f"message.usage.{c}")).alias(c)
    ends = rows.groupBy(by).agg(F.max_by("delta.stop_reason", F.when(F.col("delta.stop_reason").isNotNull(), F.col("seq"))).alias("stop"), F.struct(most("input_tokens"), most("output_tokens"), most("cache_creation_input_tokens"), most("cache_read_input_tokens")).alias("usage"), F.max("error.message").alias("error"), (~F.bool_or(F.col("type") == "message_stop")).alias("cut"))
    return ends.join(content, by, "left").withColumn("finish_reason", finish_reason(F.col("stop"))).drop("stop")


def finish_reason(stop: Column) -> Column:
    """The common name of a stop reason."""
    names = {"end_turn": "stop", "stop_sequence": "stop", "max_tokens": "length", "tool_use": "tool_calls", "refusal": "content_filter"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), stop), stop)


def openai_body(body: Column) -> Column:
    """struct(output, thinking, refusal, finish_reason, tool_calls, usage, error) of a whole JSON reply; an error object wins."""
    call = "struct<id:string,function:struct<name:string,arguments:string>>"
    j = F.from_json(body, f"choices array<struct<message:struct<content:string,reasoning_content:string,refusal:string,tool_calls:array<{call}>>,finish_reason:string>>, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,prompt_cache_hit_tokens:bigint,prompt_tokens_details:struct<cached_tokens:bigint>>, error struct<message:string>")
    m = F.get(j["choices"], F.lit(0))
    cached = F.greatest(F.coalesce(j["usage"]["prompt_cache_hit_tokens"], F.lit(0)), F.coalesce(j["usage"]["prompt_tokens_details"]["cached_tokens"], F.lit(0)))
    error = F.when(j["error"].isNotNull(), j["error"]["message"]).when(m.isNull(), "no choices").when(m["message"]["refusal"].isNotNull(), F.concat(F.lit("refused: "), m["message"]["refusal"]))
    return F.struct(m["message"]["content"].alias("output"), m["message"]["reasoning_content"].alias("thinking"), m["finish_reason"].alias("finish_reason"), m["message"]["tool_calls"].alias("tool_calls"), j["usage"]["prompt_tokens"].alias("prompt_tokens"), j["usage"]["completion_tokens"].alias("completion_tokens"), cached.alias("cached_prompt_tokens"), error.alias("error"))


def anthropic_body(body: Column) -> Column:
    """The same struct for a whole message; a refusal and an error object win."""
    block = "struct<type:string,id:string,name:string,text:string,thinking:string,input:variant>"
    usage = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"
    j = F.from_json(body, f"content array<{block}>, stop_reason string, usage {usage}, error struct<message:string>")
    text = lambda kind, field: F.array_join(F.transform(F.filter(j["content"], lambda b: b["type"] == kind), lambda b: b[field]), "")
    calls = F.transform(F.filter(j["content"], lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), F.to_json(b["input"]).alias("arguments")))
    error = F.when(j["error"].isNotNull(), j["error"]["message"]).when(j["content"].isNull(), "no content").when(j["stop_reason"] == "refusal", "refused")
    return F.struct(text("text", "text").alias("output"), text("thinking", "thinking").alias("thinking"), finish_reason(j["stop_reason"]).alias("finish_reason"), calls.alias("tool_calls"), anthropic_usage(j["usage"]).alias("usage"), error.alias("error"))


def anthropic_usage(u: Column) -> Column:
    """Prompt tokens count what was read from and written to the cache too."""
    n = lambda c: F.coalesce(u[c], F.lit(0))
    prompt = n("input_tokens") + n("cache_creation_input_tokens") + n("cache_read_input_tokens")
    return F.struct(prompt.alias("prompt_tokens"), n("output_tokens").alias("completion_tokens"), (prompt + n("output_tokens")).alias("total_tokens"), n("cache_read_input_tokens").alias("cached_prompt_tokens"))


def http_error(status: Column, retry_after: Column) -> Column:
    """struct(kind, retryable, retry_after) of a gateway's HTTP status; null for success."""
    kind = F.when(status == 401, "unauthorized").when(status == 403, "forbidden").when(status == 429, "rate_limited").when(status >= 500, "server").when(status >= 400, "rejected").when(status >= 300, "redirect")
    retry = kind.isin("rate_limited", "server") & ~status.isin(501, 505)
    wait = F.when(status.isin(429, 503, 529), retry_after)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), retry.alias("retryable"), wait.alias("retry_after")))


def error_detail(body: Column, most: int = 300) -> Column:
    v = F.try_parse_json(body)
    return F.substring(F.coalesce(F.try_variant_get(v, "$.error.message", "string"), F.try_variant_get(v, "$.message", "string"), body), 1, most)


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a whole number, or an HTTP date from now, rounded up and 0 if it is over; null for other text."""
    text = F.trim(header)
    number = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("bigint"))
    date = F.try_to_timestamp(F.regexp_extract(text, r"^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    left = F.ceil((F.unix_micros(date) - F.unix_micros(now)) / 1_000_000)
    return F.coalesce(number, F.when(date.isNotNull(), F.greatest(F.lit(0), left)))


def group_messages(messages: DataFrame, by: str = "request_id") -> DataFrame:
    """messages (pos, role, content) as provider messages: results of tools in a row become one user message, blank text goes."""
    rows = messages.where((F.col("role") == "tool") | (F.trim("content") != ""))
    order = Window.partitionBy(by).orderBy("pos")
    new = ~((F.col("role") == "tool") & F.coalesce(F.lag("role").over(order) == "tool", F.lit(False)))
    rows = rows.withColumn("group", F.sum(new.cast("int")).over(order))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    return rows.groupBy(by, "group").agg(F.when(F.first("role") == "tool", "user").otherwise(F.first("role")).alias("role"), blocks.alias("blocks"))


def request_body(rows: DataFrame) -> DataFrame:
    """rows (model, messages, tools, tool_choice, stream, max_tokens) as JSON without nulls."""
    options = F.when(F.col("stream"), F.struct(F.lit(True).alias("include_usage")))
    return rows.withColumn("body", F.to_json(F.struct("model", "messages", "tools", "tool_choice", "stream", options.alias("stream_options"), "max_tokens")))


def merged_json(extra: Column, typed: Column) -> Column:
    """Two JSON objects in one; the typed one's keys win."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    a, b = as_map(extra), as_map(typed)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


def usage_sum(rows: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """Sums of unsigned 64-bit counters that stop at the largest value."""
    most = F.lit(str(2**64 - 1)).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(*[F.least(F.sum(F.col(c).cast("decimal(20,0)")), most).cast("decimal(20,0)").alias(c) for c in counters])


def effective_parameters(defaults: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    b = overrides.select("model", *[F.col(c).alias(f"_{c}") for c in columns])
    return defaults.join(b, "model", "left").select("model", *[F.coalesce(f"_{c}", c).alias(c) for c in columns])
