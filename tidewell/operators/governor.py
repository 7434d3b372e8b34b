"""Health of engines from a log of request outcomes: suspensions, pacing, budgets, merged states.

log: engine, ts (ms), ordinal, kind (ok, challenge, upstream, timeout), status, retry_after (s).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import LONGEST_SUSPENSION, SUSPENSION
from .slices import SLICE, WIDTH, carried, earlier, inside, running_sum, sliced


def suspension(kind: Column, status: Column, retry_after: Column) -> Column:
    """struct(seconds, reason) that a failure suspends an engine for; null for none."""
    s = lambda seconds, reason: F.struct(seconds.cast("long").alias("seconds"), F.lit(reason).alias("reason"))
    fixed = lambda name: s(F.lit(SUSPENSION[name]), name)
    out = (
        F.when(kind == "challenge", fixed("challenge"))
        .when((kind == "upstream") & retry_after.isNotNull(), s(F.least(retry_after, F.lit(LONGEST_SUSPENSION)), "retry_after"))
        .when((kind == "upstream") & (status == 403), fixed("http_403"))
        .when((kind == "upstream") & (status == 429), fixed("http_429"))
        .when((kind == "upstream") & status.between(500, 599), fixed("upstream"))
        .when(kind == "timeout", fixed("timeout"))
    )
    return F.when(out["seconds"] > 0, out)


def suspensions(log: DataFrame, by: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """log with until (ms) and reason after each row: the latest expiry since the last success, of equal ones the first.

    Runs between successes are islands, and within one the expiry is a running maximum; both in slices of `width` ms,
    of which each leaves its last success behind and the latest expiry after it.
    """
    by = by or ["engine"]
    order = inside(by, "ts", "ordinal")
    s = suspension(F.col("kind"), F.col("status"), F.col("retry_after"))
    out = sliced(log, "ts", width).withColumn("_s", s).withColumn("_run", F.sum(F.coalesce((F.col("kind") == "ok").cast("int"), F.lit(0))).over(order))
    cand = F.when(F.col("_s").isNotNull(), F.struct((F.col("ts") + F.col("_s.seconds") * 1000).alias("until"), (-F.col("ts")).alias("a"), (-F.col("ordinal")).alias("b"), F.col("_s.reason").alias("reason")))
    out = out.withColumn("_c", cand).withColumn("_best", F.max("_c").over(Window.partitionBy(*by, SLICE, "_run").orderBy("ts", "ordinal")))
    # a slice leaves the best of its last island; if it is all one island, that of the slices before counts on
    left = {"_ok": F.max("_run"), "_tail": F.max_by("_best", F.struct("ts", "ordinal"))}
    island = F.sum((F.col("_ok") > 0).cast("int")).over(Window.partitionBy(*by).orderBy(SLICE))
    small = out.groupBy(*by, SLICE).agg(*[v.alias(k) for k, v in left.items()]).withColumn("_island", island)
    small = small.withColumn("_after", F.max("_tail").over(Window.partitionBy(*by, "_island").orderBy(SLICE)))
    small = small.withColumn("_carry", F.lag("_after").over(Window.partitionBy(*by).orderBy(SLICE))).select(*by, SLICE, "_carry").withColumnsRenamed({c: f"{c}_k" for c in [*by, SLICE]})
    out = out.join(small, [out[c].eqNullSafe(small[f"{c}_k"]) for c in by] + [out[SLICE] == small[f"{SLICE}_k"]]).drop(*[f"{c}_k" for c in [*by, SLICE]])
    best = F.when(F.col("_run") == 0, F.greatest("_best", "_carry")).otherwise(F.col("_best"))
    return out.withColumn("_b", best).withColumn("until", F.col("_b.until")).withColumn("reason", F.col("_b.reason")).drop(SLICE, "_s", "_run", "_c", "_best", "_carry", "_b")


def remaining(until: Column, now: Column) -> Column:
    """Seconds left of a suspension at a time, at least 1; null when it is over."""
    return F.when(until > now, F.greatest(F.lit(1), F.floor((until - now) / 1000)))


def pacing(requests: DataFrame, gap_ms: Column | int, by: str = "engine", width: int = WIDTH) -> DataFrame:
    """requests (ts) with wait_ms until the gap since the one before has passed."""
    gap = F.lit(gap_ms) if isinstance(gap_ms, int) else gap_ms
    out = sliced(requests, "ts", width).withColumn("_lag", F.lag("ts").over(inside([by], "ts", "ordinal")))
    out = carried(out, [by], {"_end": F.max("ts")}, {"_last": F.max("_end").over(earlier([by]))})
    before = F.coalesce("_lag", "_last")
    return out.withColumn("wait_ms", F.coalesce(F.greatest(F.lit(0), gap - (F.col("ts") - before)), F.lit(0))).drop(SLICE, "_lag", "_last")


def slots(requests: DataFrame, gap_ms: int = 1000, by: str = "engine", width: int = WIDTH) -> DataFrame:
    """requests (ts) with the time each is let through when at most one passes in gap_ms.

    slot_n = max(ts_n, slot_(n-1) + gap) is a running maximum of ts_i - i gap, shifted back by n gap. A slice is the pair
    of its number of rows and its maximum; pairs join by adding the first and shifting the second.
    """
    order = inside([by], "ts", "ordinal")
    out = sliced(requests, "ts", width).withColumn("_n", F.row_number().over(order))
    out = out.withColumn("_free", F.col("ts") - F.col("_n") * gap_ms).withColumn("_m", F.max("_free").over(order))
    small = out.groupBy(by, SLICE).agg(F.count("*").alias("_rows"), F.max("_free").alias("_top"))
    small = small.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier([by])), F.lit(0)))
    small = small.withColumn("_held", F.max(F.col("_top") - F.col("_before") * gap_ms).over(earlier([by]))).select(F.col(by).alias("_by"), F.col(SLICE).alias("_at"), "_before", "_held")
    out = out.join(small, out[by].eqNullSafe(small["_by"]) & (out[SLICE] == small["_at"]))
    slot = F.greatest(F.col("_m") - F.col("_before") * gap_ms, F.col("_held")) + (F.col("_n") + F.col("_before")) * gap_ms
    return out.withColumn("slot", slot).drop(SLICE, "_n", "_free", "_m", "_by", "_at", "_before", "_held")


def budgets(requests: DataFrame, caps: DataFrame, by: list[str], width: int = WIDTH) -> DataFrame:
    """requests (engine) with throttled: beyond the engine's request_cap in a run."""
    capped = requests.join(F.broadcast(caps.select("engine", "request_cap")), "engine")  # one row for each engine
    out = running_sum(sliced(capped, "ts", width), [*by, "engine"], F.lit(1), "_nth", "ts", "ordinal")
    return out.withColumn("throttled", F.col("_nth") > F.col("request_cap")).drop(SLICE, "_nth")


def gate(requests: DataFrame) -> DataFrame:
    """requests (until, throttled, wait_ms, ts) with decision: suspended, throttled or proceed."""
    return requests.withColumn("decision", F.when(F.col("until") > F.col("ts"), "suspended").when(F.col("throttled"), "throttled").otherwise("proceed"))


def overlaps(requests: DataFrame, limit: Column | int, by: str = "engine", width: int = WIDTH) -> DataFrame:
    """Times (start, end) at which more than limit requests were in flight: a sweep over starts and ends, not a self-join."""
    ends = requests.select(by, F.inline(F.array(F.struct(F.col("start").alias("ts"), F.lit(1).alias("step")), F.struct(F.col("end").alias("ts"), F.lit(-1).alias("step")))))
    one = ends.groupBy(by, "ts", "step").agg(F.count("*").alias("_times"))  # starts, or ends, of one time count together
    flight = running_sum(sliced(one, "ts", width), [by], F.col("step") * F.col("_times"), "in_flight", "ts", "step")
    out = flight.where(F.col("in_flight") > (F.lit(limit) if isinstance(limit, int) else limit))
    return out.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).drop(SLICE, "_times", "_again")


def merge_states(local: DataFrame, disk: DataFrame, now_ms: int) -> DataFrame:
    """States (engine, until, at, reason, last_request, last_success) of two processes in one.

    Latest request and success; the later expiry wins; a suspension not newer than the latest success is dead; none lasts beyond the cap.
    """
    a, b = local.alias("a"), disk.alias("b")
    success = F.greatest("a.last_success", "b.last_success")
    live = lambda x: F.when(F.col(f"{x}.until").isNotNull() & (success.isNull() | (F.col(f"{x}.at") > success)), F.struct(F.col(f"{x}.until").alias("until"), F.col(f"{x}.at").alias("at"), F.col(f"{x}.reason").alias("reason")))
    x, y = live("a"), live("b")
    best = F.when(y.isNull() | (x["until"] >= y["until"]), x).otherwise(y)
    both = a.join(b, F.col("a.engine") == F.col("b.engine"), "full_outer")
    return both.select(
        F.coalesce("a.engine", "b.engine").alias("engine"), F.when(best.isNotNull(), F.least(best["until"], F.lit(now_ms + LONGEST_SUSPENSION * 1000))).alias("until"), best["at"].alias("at"), best["reason"].alias("reason"),
        F.greatest("a.last_request", "b.last_request").alias("last_request"), success.alias("last_success"),
    )


def jittered_gap(least: Column, most: Column, seed: int = 0) -> Column:
    return least + F.floor(F.rand(seed) * (F.greatest(most, least) - least + 1))


def settings(engines: DataFrame, overrides: DataFrame, name: str, default: Column) -> DataFrame:
    """engine and value of a setting: the engine's override, else the global one (engine null), else default."""
    own = overrides.where(F.col("name") == name)
    per = own.where("engine IS NOT NULL").select("engine", F.col("value").alias("_own"))
    every = own.where("engine IS NULL").agg(F.max("value").alias("_all"))
    one = engines.withColumn("_k", F.lit(1)).join(F.broadcast(every.withColumn("_k", F.lit(1))), "_k")  # one row
    return one.join(per, "engine", "left").select("engine", F.coalesce("_own", "_all", default).alias("value"))


def backoff(attempt: Column, retry_after: Column | None = None, seed: int = 0) -> Column:
    """Seconds to wait before a retry: full jitter below 2^(n-1), 8 at most; a stated time wins, 60 at most."""
    jitter = F.rand(seed) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(3)))
    return jitter if retry_after is None else F.coalesce(F.least(retry_after.cast("double"), F.lit(60.0)), jitter)


def retries(attempts: DataFrame, by: list[str], most: int = 4, deadline_ms: int = 120_000) -> DataFrame:
    """attempts (n from 1, kind, retryable, start, end) with allowed: after retryable failures only, one after a timeout, in number and time."""
    order = Window.partitionBy(*by).orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_retryable = F.coalesce(F.min(F.col("retryable").cast("int")).over(before), F.lit(1)) == 1
    timeouts = F.coalesce(F.sum((F.col("kind") == "timeout").cast("int")).over(before), F.lit(0))
    first = F.min("start").over(Window.partitionBy(*by))
    return attempts.withColumn("allowed", all_retryable & (timeouts <= 1) & (F.col("n") <= most) & (F.col("start") - first < deadline_ms))


def transport_retry(attempts: DataFrame, by: list[str], pause_ms: int = 500) -> DataFrame:
    """attempts (n, kind, end, deadline) with retry: a first transport failure (upstream without status) that leaves time for another."""
    return attempts.withColumn("retry", (F.col("n") == 1) & (F.col("kind") == "upstream") & F.col("status").isNull() & (F.col("end") + pause_ms < F.col("deadline")))
