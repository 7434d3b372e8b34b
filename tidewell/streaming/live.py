"""Live forms of progress, suspensions and cache lookups; each gives the rows of its batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import render
from .ordered import Fold, folded
from .stateful import seconds_for

#: Microseconds of an hour, and characters that are kept of a reply being streamed.
HOUR = 3_600_000_000
TAIL = 200


class SessionFold(Fold):
    """A session as it goes on: each event's line, the status it leaves, and the end of the reply being streamed.

    Rows: type, line, tone, status, counts (of a verification), channel and text and attempt (of a fragment). State ends
    with the session, or after `idle` us without an event.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def step(self, state, at, seq, row):
        kind, line = row["type"], row.get("line")
        state["seen"] = at
        if kind in ("turn.started", "model.retry", "model.replied"):
            state["partial"] = {}
        if kind == "answer.verified":
            state["checked"] = row.get("counts")
        if kind == "session.finished" and row.get("tone") == "good" and state.get("checked"):
            line = f"{line}, {state['checked']}"
        partial = state.setdefault("partial", {})
        if kind == "model.delta":
            if partial.get("attempt") != row.get("attempt"):
                partial.clear()
                partial["attempt"] = row.get("attempt")
            text = row.get("text") or ""
            channel = row.get("channel") or "text"
            partial[channel] = partial.get(channel, 0) + len(text)
            if channel == "text":
                flat = "".join(" " if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in text)
                partial["tail"] = (partial.get("tail", "") + flat)[-TAIL:]
        out = [{"type": kind, "line": line, "tone": row.get("tone"), "status": row.get("status"), "tail": partial.get("tail", ""), "chars": partial.get("text", 0)}]
        if kind == "session.finished":
            state.clear()
        return out

    def wake(self, state):
        return state["seen"] + self.idle if state else None

    def woken(self, state, at):
        state.clear()
        return []


PROGRESS = "type string, line string, tone string, status string, tail string, chars long"


def live_progress(events: DataFrame, late: str = "10 minutes", idle: int = 24 * HOUR) -> DataFrame:
    """events (session_id, at, seq, type, data) as a stream -> session_id, seq, type, line, tone, status, tail, chars.

    line, tone and status are those of render.progress; lines are worked out before the state is asked, which only adds
    the last verification. tail: the end of the reply that is being streamed, chars: how long it is so far.
    """
    shown = render.lines(events, F.lit(None).cast("string"))
    delta = F.from_json("data", "channel string, text string, attempt long")
    row = F.to_json(F.struct("type", "line", "tone", "status", "counts", delta["channel"].alias("channel"), delta["text"].alias("text"), delta["attempt"].alias("attempt")))
    stream = shown.select(F.col("session_id").cast("string").alias("key"), "at", F.lit(0).alias("rank"), "seq", row.alias("row"))
    return folded(stream, SessionFold(idle), late, PROGRESS).select(F.col("key").alias("session_id"), "seq", "type", "line", "tone", "status", "tail", "chars")


class SuspensionFold(Fold):
    """The suspension of an engine after each request, and a row when it ends by itself.

    skip: requests while it lasts are not made; they are answered "suspended" and change nothing.
    """

    def __init__(self, skip: bool):
        self.skip = skip

    def step(self, state, at, seq, row):
        at, until = at // 1000, state.get("until")
        decision = "suspended" if self.skip and until is not None and until > at else "ran"
        if decision == "ran" and row["kind"] == "ok":
            state.clear()
        elif decision == "ran" and (found := seconds_for(row["kind"], row.get("status"), row.get("retry_after"))):
            end = at + found[0] * 1000
            if until is None or end > until:
                state |= {"until": end, "reason": found[1], "told": False}
        return [{"decision": decision, "until": state.get("until"), "reason": state.get("reason")}]

    def wake(self, state):
        return state["until"] * 1000 if state and not state["told"] else None

    def woken(self, state, at):
        state["told"] = True
        return [{"decision": "over", "until": state["until"], "reason": state["reason"]}]


SUSPENDED = "decision string, until long, reason string"


def live_suspensions(log: DataFrame, late: str = "10 minutes", skip: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """log (engine, ts, ordinal, kind, status, retry_after) as a stream in any order -> engine, ts, ordinal, decision, until, reason.

    Rows of a request have what governor.suspensions gives (with skip False); decision "over" marks the end of a
    suspension that no success ended, with ordinal -1. initial: key and state from another run (kept_states), or
    merged_states as such (as_states).
    """
    row = F.to_json(F.struct("kind", "status", "retry_after"))
    stream = log.select(F.col("engine").alias("key"), F.timestamp_millis("ts").alias("at"), F.lit(0).alias("rank"), F.col("ordinal").alias("seq"), row.alias("row"))
    out = folded(stream, SuspensionFold(skip), late, SUSPENDED, initial)
    return out.select(F.col("key").alias("engine"), F.floor(F.col("at") / 1000).alias("ts"), F.col("seq").alias("ordinal"), "decision", "until", "reason")


def as_states(suspensions: DataFrame, now: Column) -> DataFrame:
    """engine, until, reason -> what live_suspensions starts with; ended ones have been told."""
    return suspensions.where("until IS NOT NULL").select(F.col("engine").alias("key"), F.to_json(F.struct("until", "reason", (F.col("until") <= now).alias("told"))).alias("state"))


class CacheFold(Fold):
    """The store that answers lookups of one cache key: the latest at or before a lookup, while it is young enough."""

    def __init__(self, day: int, other: int):
        self.day, self.other = day, other

    def _ends(self, state) -> int:
        return state["at"] + (self.day if state["short"] else self.other)

    def step(self, state, at, seq, row):
        if row["store"]:
            state |= {"at": at, "seq": seq, "short": row["short"]}
            return []
        return [{"stored_at": state.get("at"), "store": state.get("seq")}]

    def wake(self, state):
        return self._ends(state) + 1 if state else None

    def woken(self, state, at):
        state.clear()
        return []


def live_lookups(events: DataFrame, late: str = "10 minutes", day: int = HOUR, other: int = 24 * HOUR) -> DataFrame:
    """events (cache_key, at, seq, is_store, short) as a stream -> for each lookup: cache_key, seq, stored_at (us) and store (seq) that answers it, or nulls.

    A store lives for `other` us, a short one (results of the last day) for `day`; its state goes with it. Stores come
    before lookups of the same time.
    """
    row = F.to_json(F.struct(F.col("is_store").alias("store"), "short"))
    stream = events.select(F.col("cache_key").alias("key"), "at", F.when(F.col("is_store"), 0).otherwise(1).alias("rank"), "seq", row.alias("row"))
    return folded(stream, CacheFold(day, other), late, "stored_at long, store long").select(F.col("key").alias("cache_key"), "seq", "stored_at", "store")


class AttemptFold(Fold):
    """The attempts of a turn: what arrives of the highest so far is kept, what arrives later of a lower one is left out.

    When a higher one begins, one row takes back all that was kept of the lower ones, so the state holds no
    fragments. A row that is delivered again has the same time and number and comes right behind the first.
    State ends `idle` us after the last row.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def step(self, state, at, seq, row):
        attempt, top, again = row.get("attempt"), state.get("top"), state.get("last") == [at, seq]
        state |= {"last": [at, seq], "seen": at}
        if again or attempt is None or (top is not None and attempt < top):
            return []
        state["top"] = attempt
        kept = {"attempt": attempt, "change": "kept"}
        return [kept] if top is None or attempt == top else [{"attempt": attempt, "change": "retracted"}, kept]

    def wake(self, state):
        return state["seen"] + self.idle if state else None

    def woken(self, state, at):
        state.clear()
        return []


def live_attempts(deltas: DataFrame, late: str = "10 minutes", idle: int = 24 * HOUR) -> DataFrame:
    """deltas (turn_key, at, seq, attempt) as a stream -> turn_key, seq, attempt, change.

    kept: the delta counts so far. retracted: all kept ones of lower attempts are void, as this one is the first of its
    attempt. Deltas without an attempt are left out.
    """
    row = F.to_json(F.struct(F.col("attempt").cast("long").alias("attempt")))
    stream = deltas.select(F.col("turn_key").cast("string").alias("key"), "at", F.lit(0).alias("rank"), "seq", row.alias("row"))
    return folded(stream, AttemptFold(idle), late, "attempt long, change string").select(F.col("key").alias("turn_key"), "seq", "attempt", "change")


def in_force(changes: DataFrame) -> DataFrame:
    """Rows of live_attempts with in_force: kept and not taken back; those are the rows of history.last_attempts."""
    void = changes.where("change = 'retracted'").groupBy("turn_key").agg(F.max("attempt").alias("_first"))
    return changes.join(void, "turn_key", "left").withColumn("in_force", (F.col("change") == "kept") & (F.col("attempt") >= F.coalesce("_first", "attempt"))).drop("_first")
