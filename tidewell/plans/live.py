"""Queries that run streams: each log arrives in slices, out of order within the watermark, on one checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming import live, replies
from ..streaming.ordered import kept_states, run_to_end
from . import queries as plans
from .registry import ORACLE_SQL, query
from .tables import LOG_SQL, engine_log, scratch, table

EPOCH = "1970-01-01 00:00:00"


def _slices(rows: DataFrame, at: Column, end: DataFrame | None = None, days: tuple[int, ...] = (10, 20)) -> list[DataFrame]:
    """rows in three slices by time (cut at days of January 2024), each dealt by a hash so that its rows come in no order; end joins the last."""
    cuts = [F.lit(f"2024-01-{d + 1:02d}").cast("timestamp") for d in days]
    parts = [rows.where(at < cuts[0]), rows.where((at >= cuts[0]) & (at < cuts[1])), rows.where(at >= cuts[1])]
    if end is not None:
        parts[-1] = parts[-1].unionByName(end)
    return [p.repartition(F.xxhash64(*p.columns)) for p in parts]


def _instant(c: str) -> Column:
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz")))


LAST = "2024-06-01"


_SESSION = "coalesce(sum((event_type = 'purchase' AND event_id % 2 <> 0)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session"


@query(
    ORACLE_SQL["progress_lines"].replace("SELECT event_id,", "SELECT user_id, session::BIGINT AS session, event_id,", 1)
    .replace("AS checked FROM events)", f"AS checked, {_SESSION} FROM events)").replace("PARTITION BY user_id ORDER BY event_id) AS counts", "PARTITION BY user_id, session ORDER BY event_id) AS counts")
)
def live_progress(spark, d):
    """STR-03: every event as it arrives, from three slices out of order, in the lines of the batch form. A user's next session begins when one has finished."""
    rows = plans.progress_events(spark, d).join(table(spark, d, "events").select("event_id", _instant("ts").alias("at")), "event_id")
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    number = F.coalesce(F.sum((F.col("type") == "session.finished").cast("long")).over(before), F.lit(0))
    rows = rows.select(F.concat_ws("-", "session_id", number).alias("session_id"), "at", F.col("seq").cast("long").alias("seq"), "type", "data")
    beat = spark.range(1).select(F.lit("beat").alias("session_id"), F.lit(LAST).cast("timestamp").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit("beat").alias("type"), F.lit("{}").alias("data"))
    out = run_to_end(_slices(rows, F.col("at"), beat), lambda s: live.live_progress(s, idle=24 * 90 * live.HOUR), scratch(spark, "progress")).where("session_id <> 'beat'")
    part = lambda i: F.split_part("session_id", F.lit("-"), F.lit(i)).cast("long")
    return out.select(part(1).alias("user_id"), part(2).alias("session"), F.col("seq").alias("event_id"), "line", "tone", "status")


_AFTER = f"""
WITH {LOG_SQL}, r AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY engine ORDER BY ts, ordinal) AS run FROM log),
b AS (SELECT engine, ts, ordinal, max(CASE WHEN bad THEN struct_pack(until := ts + secs * 1000, a := -ts, b := -ordinal, why := why) END) OVER (PARTITION BY engine, run ORDER BY ts, ordinal) AS s FROM r),
c AS (SELECT engine, ts, ordinal, CAST(s.until AS BIGINT) AS until, s.why AS reason, lead(ts) OVER (PARTITION BY engine ORDER BY ts, ordinal) AS next FROM b)
SELECT engine, ts, ordinal, 'ran' AS decision, until, reason FROM c
UNION ALL SELECT engine, until, -1, 'over', until, reason FROM c WHERE until > ts AND (next IS NULL OR until <= next)
"""


def _log_end(spark) -> DataFrame:
    return spark.range(1).select(F.lit("beat").alias("engine"), F.unix_millis(F.lit(LAST).cast("timestamp")).alias("ts"), F.lit(0).cast("long").alias("ordinal"), F.lit("ok").alias("kind"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("long").alias("retry_after"))


@query(_AFTER)
def live_suspensions(spark, d):
    """STR-07: suspensions of every request, and their ends by timer, from three slices out of order."""
    log = engine_log(spark, d)
    out = run_to_end(_slices(log, F.timestamp_millis("ts"), _log_end(spark)), live.live_suspensions, scratch(spark, "suspensions"))
    return out.where("engine <> 'beat'")


@query(_AFTER)
def resumed_suspensions(spark, d):
    """STR-08, STR-09: the log in two runs of their own; the second starts with the states that the first left in its store."""
    log = engine_log(spark, d)
    cut = F.unix_millis(F.lit("2024-01-15").cast("timestamp"))
    first, second = scratch(spark, "first-run"), scratch(spark, "second-run")
    quiet = _log_end(spark).withColumn("ts", cut + 600_000)  # the watermark passes the first part
    one = run_to_end([log.where(F.col("ts") < cut), quiet], live.live_suspensions, first)
    states = kept_states(spark, first).where("key <> 'beat'")
    two = run_to_end([log.where(F.col("ts") >= cut), _log_end(spark)], lambda s: live.live_suspensions(s, initial=states), second)
    return one.unionByName(two).where("engine <> 'beat'")


@query("""
WITH l AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), s AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type IN ('view', 'purchase') GROUP BY user_id, ts),
j AS (SELECT l.event_id, l.ts, s.ts AS stored, s.event_id AS store FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts >= s.ts)
SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(stored) <= CASE WHEN store % 2 = 0 THEN 3600000000 ELSE 86400000000 END THEN store END AS store FROM j
""")
def live_lookups(spark, d):
    """JN-11, STR-16: every click looks up the stores of its user (views and purchases; every other one lives an hour, the rest a day)."""
    e = table(spark, d, "events").where("event_type IN ('click', 'view', 'purchase')")
    rows = e.select(F.col("user_id").cast("string").alias("cache_key"), _instant("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "click").alias("is_store"), (F.col("event_id") % 2 == 0).alias("short"))
    beat = spark.range(1).select(F.lit("beat").alias("cache_key"), F.lit(LAST).cast("timestamp").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(True).alias("is_store"), F.lit(True).alias("short"))
    out = run_to_end(_slices(rows, F.col("at"), beat), live.live_lookups, scratch(spark, "lookups"))
    return out.select(F.col("seq").alias("event_id"), "store")


@query("""
WITH r AS (SELECT event_id, event_id % 3 AS attempt, max(event_id % 3) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top,
           max(event_id % 3) OVER (PARTITION BY user_id, event_type) AS final FROM events)
SELECT event_id, attempt, 'kept' AS change, attempt = final AS in_force FROM r WHERE attempt >= coalesce(top, -1)
UNION ALL SELECT event_id, attempt, 'retracted', false FROM r WHERE attempt > top
""")
def live_attempts(spark, d):
    """WIN-10, STR-02: deltas of attempts as they come, from three slices out of order, every eleventh delivered again at once and in the next slice."""
    e = table(spark, d, "events").select(F.concat_ws("-", "user_id", "event_type").alias("turn_key"), _instant("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("attempt"))
    again = e.where("seq % 11 = 0")
    beat = spark.range(1).select(F.lit("beat").alias("turn_key"), F.lit(LAST).cast("timestamp").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("attempt"))
    first, second, third = _slices(e.unionByName(again), F.col("at"), beat)
    repeats = again.where(F.col("at") < F.lit("2024-01-11").cast("timestamp"))
    out = run_to_end([first, second.unionByName(repeats), third], lambda s: live.live_attempts(s, idle=24 * 90 * live.HOUR), scratch(spark, "attempts"))
    return live.in_force(out.where("turn_key <> 'beat'")).select(F.col("seq").alias("event_id"), "attempt", "change", "in_force")


def _frames(spark, d, wire: str) -> DataFrame:
    """Each conversation as the bytes of one streamed reply: assistant turns are text, user turns the arguments of two tool calls, system turns thinking."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    js = lambda **c: F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in c.items()]))
    of = lambda **c: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in c.items()])
    text, index, role, i = F.col("text"), F.when(F.col("role") == "user", 2 + F.col("turn") % 4).otherwise(F.when(F.col("role") == "system", 0).otherwise(1)), F.col("role"), F.col("conv_id")
    if wire == "openai":
        chat = lambda **delta: js(choices=F.array(of(delta=of(**delta))))
        call = chat(tool_calls=F.array(of(index=(index - 2).cast("int"), id=F.concat(F.lit("c"), index.cast("string")), function=of(name="search", arguments=text))))
        data = F.when(role == "user", call).when(role == "system", chat(reasoning_content=text)).otherwise(chat(content=text))
        head, tail = F.array(), F.array(js(choices=F.array(of(delta=of(content=F.lit(None).cast("string")), finish_reason="stop"))), js(usage=of(prompt_tokens=i, completion_tokens=i + 1, total_tokens=i * 2 + 1)), F.lit("[DONE]"))
    else:
        delta = F.when(role == "user", of(type="input_json_delta", partial_json=text, text=F.lit(None).cast("string"), thinking=F.lit(None).cast("string")))
        delta = delta.when(role == "system", of(type="thinking_delta", partial_json=F.lit(None).cast("string"), text=F.lit(None).cast("string"), thinking=text)).otherwise(of(type="text_delta", partial_json=F.lit(None).cast("string"), text=text, thinking=F.lit(None).cast("string")))
        data = js(type="content_block_delta", index=index.cast("int"), delta=delta)
        start = lambda n, **block: js(type="content_block_start", index=n, content_block=of(**block))
        head = F.array(js(type="message_start", message=of(usage=of(input_tokens=i + 3, output_tokens=1))), start(0, type="thinking"), start(1, type="text", text=""), *[start(n, type="tool_use", id=f"c{n}", name="search") for n in range(2, 6)])
        tail = F.array(js(type="message_delta", delta=of(stop_reason="end_turn"), usage=of(output_tokens=7 + i % 5)), js(type="message_stop"))
    turns = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", data.alias("data")))), lambda x: x["data"]).alias("turns"))
    framed = F.transform(F.concat(head, "turns", tail), lambda x: F.concat(F.lit(": ping\nevent: x\ndata: "), x, F.lit("\r\n\r\n")))
    return turns.select(F.col("conv_id").cast("string").alias("stream_id"), F.array_join(framed, "").cast("binary").alias("body"))


def _chunks(spark, d, wire: str) -> list[DataFrame]:
    """The bytes cut into chunks of 1000, 200 or 37 bytes, that arrive in three slices in any order, some twice."""
    width = F.element_at(F.array(F.lit(1000), F.lit(200), F.lit(37)), (F.col("stream_id").cast("long") % 3 + 1).cast("int"))
    last = F.floor((F.octet_length("body") - 1) / F.col("width")).cast("int")
    # chunks are cut inside the row: a body is not copied beside each of its chunks
    each = F.transform(F.sequence(F.lit(0), last), lambda n: F.struct(n.cast("long").alias("chunk_seq"), F.substr("body", n * F.col("width") + 1, F.col("width")).alias("chunk")))
    cut = _frames(spark, d, wire).withColumn("width", width).select("stream_id", F.explode(each).alias("x")).select("stream_id", "x.chunk_seq", "x.chunk")
    slot = F.pmod(F.xxhash64("stream_id", "chunk_seq"), F.lit(3))
    arrive = lambda k: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * k)).alias("at")
    again = F.pmod(F.xxhash64("chunk_seq", "stream_id"), F.lit(11)) == 0
    beat = spark.range(1).select(F.lit("-1").alias("stream_id"), F.lit(0).cast("long").alias("chunk_seq"), F.lit("").cast("binary").alias("chunk"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("at"))
    parts = [cut.where((slot == k) | (again & ((slot + 1) % 3 == k))).select("*", arrive(k)) for k in range(3)]
    parts[2] = parts[2].unionByName(beat)
    return [p.repartition("stream_id") for p in parts]


_TURNS = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, 2 + turn %% 4 AS nr FROM conversations),
c AS (SELECT conv_id, nr, string_agg(text, '' ORDER BY turn) AS a FROM t WHERE role = 'user' GROUP BY conv_id, nr),
k AS (SELECT conv_id, string_agg('c' || nr || ' search ' || a, '|' ORDER BY nr) AS calls FROM c GROUP BY conv_id)
SELECT CAST(t.conv_id AS VARCHAR) AS stream_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS output, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'system'), '') AS thinking,
       coalesce(any_value(k.calls), '') AS calls, 'stop' AS finish_reason, %s AS tokens, false AS cut
FROM t LEFT JOIN k ON k.conv_id = t.conv_id GROUP BY t.conv_id
"""


def _calls(only_used: bool) -> Column:
    used = F.filter("tool_calls", lambda c: c["arguments"] != "") if only_used else F.col("tool_calls")
    return F.coalesce(F.array_join(F.transform(used, lambda c: F.concat_ws(" ", c["id"], c["name"], c["arguments"])), "|"), F.lit(""))


@query(_TURNS % "CAST(2 * t.conv_id + 1 AS BIGINT)")
def live_replies(spark, d):
    """STR-04, SRC-13: replies of the first wire format assembled from chunks that arrive out of order and twice."""
    out = run_to_end(_chunks(spark, d, "openai"), lambda s: replies.live_replies(s, "openai"), scratch(spark, "replies"))
    return out.where("stream_id <> '-1'").select("stream_id", "output", "thinking", _calls(False).alias("calls"), "finish_reason", F.col("usage.total_tokens").alias("tokens"), "cut")


@query(_TURNS % "CAST(t.conv_id + 10 + t.conv_id % 5 AS BIGINT)")
def live_message_replies(spark, d):
    """STR-05: replies of the second wire format, whose blocks are opened before they are filled."""
    out = run_to_end(_chunks(spark, d, "anthropic"), lambda s: replies.live_replies(s, "anthropic"), scratch(spark, "messages"))
    return out.where("stream_id <> '-1'").select("stream_id", "output", "thinking", _calls(True).alias("calls"), "finish_reason", (F.col("usage.input_tokens") + F.col("usage.output_tokens")).alias("tokens"), "cut")
