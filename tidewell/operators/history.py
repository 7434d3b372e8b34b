"""Agent sessions: context budgets, event order, traces, turn budgets, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truncate_history(entries: DataFrame, by: list[str], budget: int, fixed: Column | int = 0) -> DataFrame:
    """The longest run of newest entries (turn, chars) that fits budget - fixed, never fewer than one; with the number dropped."""
    newest = Window.partitionBy(*by).orderBy(F.desc("turn"))
    total = F.sum("chars").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    fixed = F.lit(fixed) if isinstance(fixed, int) else fixed
    out = entries.withColumn("_keep", (total + fixed <= budget) | (F.row_number().over(newest) == 1))
    dropped = F.sum((~F.col("_keep")).cast("int")).over(Window.partitionBy(*by))
    return out.withColumn("dropped", dropped).where("_keep").drop("_keep")


def with_seq(events: DataFrame, by: str = "session_id") -> DataFrame:
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy("ts", "event_id")))


def seq_gaps(events: DataFrame, by: str = "session_id") -> DataFrame:
    """Rows before which sequence numbers are missing, repeat or fall, with the step."""
    step = F.col("seq") - F.coalesce(F.lag("seq").over(Window.partitionBy(by).orderBy("seq", "ts")), F.lit(0))
    return events.withColumn("step", step).where("step <> 1")


def turn_budgets(turns: DataFrame, max_turns: int, cap: int, step: int = 5, by: str = "session_id") -> DataFrame:
    """turns (turn, success) with the budget after each: step more for each success beyond the first, at most the cap."""
    good = F.sum(F.col("success").cast("int")).over(Window.partitionBy(by).orderBy("turn"))
    return turns.withColumn("budget", F.least(F.lit(max_turns) + F.lit(step) * F.greatest(good - 1, F.lit(0)), F.lit(max(cap, max_turns))))


def failure_streak(turns: DataFrame, by: str = "session_id") -> DataFrame:
    """turns (turn, success) with the number of failures in a row up to each."""
    window = Window.partitionBy(by).orderBy("turn")
    out = turns.withColumn("_run", F.sum(F.col("success").cast("int")).over(window))
    streak = F.sum((~F.col("success")).cast("int")).over(Window.partitionBy(by, "_run").orderBy("turn"))
    return out.withColumn("streak", streak).drop("_run")


def trace_deltas(rows: DataFrame, by: str = "session_id") -> DataFrame:
    """rows (turn, messages array) -> delta: what came after the previous row's messages if they are a prefix, else all (full)."""
    before = F.lag("messages").over(Window.partitionBy(by).orderBy("turn"))
    out = rows.withColumn("_before", before)
    n = F.size("_before")
    prefix = F.col("_before").isNotNull() & (F.size("messages") >= n) & (F.slice("messages", F.lit(1), F.greatest(n, F.lit(0))) == F.col("_before"))
    prefix = F.coalesce(prefix, F.lit(False))
    return out.withColumn("full", ~prefix).withColumn("delta", F.when(prefix, F.slice("messages", n + 1, F.size("messages"))).otherwise(F.col("messages"))).drop("_before")


def rebuild_trace(rows: DataFrame, by: str = "session_id") -> DataFrame:
    """The inverse: messages of each row from delta and full."""
    order = Window.partitionBy(by).orderBy("turn")
    out = rows.withColumn("_run", F.sum(F.col("full").cast("int")).over(order))
    return out.withColumn("messages", F.flatten(F.collect_list("delta").over(Window.partitionBy(by, "_run").orderBy("turn")))).drop("_run")


def last_attempts(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Deltas (attempt) of each turn's last attempt."""
    return deltas.withColumn("_last", F.max("attempt").over(Window.partitionBy(*by))).where("attempt = _last").drop("_last")


def first_deliveries(parts: DataFrame, by: list[str]) -> DataFrame:
    """parts (pos, delivered) with first: the first row of each page that delivered one."""
    order = Window.partitionBy(*by, "delivered").orderBy("pos")
    return parts.withColumn("first", F.col("delivered") & (F.row_number().over(order) == 1))


def turn_rollup(results: DataFrame, by: list[str]) -> DataFrame:
    """Tool results (pos, tool, success, hits, failure) of a turn: good searches, any hits, last failure."""
    return results.groupBy(*by).agg(
        F.count_if(F.col("success") & (F.col("tool") == "search")).alias("good_searches"), F.bool_or(F.coalesce(F.col("hits") > 0, F.lit(False))).alias("had_hits"),
        F.max_by("failure", F.when(F.col("failure").isNotNull(), F.col("pos"))).alias("last_failure"),
    )


def session_totals(events: DataFrame, by: str = "session_id") -> DataFrame:
    """events (seq, turn, turn_budget, six token counters) -> turns used, last budget, counters that saturate at 2**64 - 1."""
    counters = ["prompt_tokens", "completion_tokens", "total_tokens", "cached_prompt_tokens", "cache_creation_tokens", "reasoning_tokens"]
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(str(2**64 - 1)).cast("decimal(30,0)"))
    return events.groupBy(by).agg(F.coalesce(F.max("turn"), F.lit(0)).alias("turns_used"), F.max_by("turn_budget", "seq").alias("turn_budget"), *[total(c).alias(c) for c in counters])


def dispatch_plan(calls: DataFrame, by: list[str], cap: int) -> DataFrame:
    """Tool calls (turn, i, id) with an id where the model gave none, and whether they are within the cap of a turn."""
    made = F.format_string("call_%d_%d", F.col("turn"), F.col("i"))
    order = Window.partitionBy(*by).orderBy("i")
    return calls.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), made)).withColumn("executed", F.row_number().over(order) <= cap)


def turns_left(budget: Column, used: Column) -> Column:
    """The note behind the newest tool result of a turn; nothing when no turn is left."""
    left = budget - used
    last = "\n\n[1 turn left: tools are off on it, so your next reply must be the final answer inside <answer></answer> tags.]"
    return F.when(left <= 0, "").when(left == 1, last).otherwise(F.concat(F.lit("\n\n["), left.cast("string"), F.lit(" turns left, counting the final answer.]")))


def evidence_urls(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Distinct URLs (pos, url) in first-seen order."""
    return evidence.groupBy(*by).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"])).alias("urls"))


def context_budget(window: Column, reserve: Column) -> Column:
    """struct(context_chars, part_chars), null where the window leaves too little."""
    room = F.least((window - reserve) * 3, F.lit(400_000))
    return F.when(room >= 16_000, F.struct(room.alias("context_chars"), F.least(F.lit(24_000), F.floor(room / 8)).alias("part_chars")))


def final_reserve(request_ms: Column, run_ms: Column) -> Column:
    return F.least(request_ms, F.floor(run_ms / 4))


def close_sessions(sessions: DataFrame) -> DataFrame:
    """sessions (outcome, log_failed, blocked, evidence, had_hits) with the final outcome and exit code."""
    outcome = F.when((F.col("outcome") == "ok") & F.col("log_failed"), "session_io").when((F.col("outcome") == "ok") & F.col("blocked") & (F.col("evidence") == 0) & ~F.col("had_hits"), "search_blocked").otherwise(F.col("outcome"))
    return sessions.withColumn("outcome", outcome).withColumn("exit_code", exit_code(F.col("outcome")))


# Outcomes of a run and the exit codes they give.
EXIT_CODES = {"ok": 0, "not_configured": 2, "gateway_exhausted": 3, "tool_failure": 4, "budget_exhausted": 5, "session_io": 6, "search_blocked": 7, "gateway_rejected": 8, "deadline_exceeded": 9, "interrupted": 130}


def exit_code(outcome: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in EXIT_CODES.items() for x in pair]), outcome), F.lit(1))
