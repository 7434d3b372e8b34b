"""Event logs as streams: windows, sessions of activity, and how long a failure suspends an engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import LONGEST_SUSPENSION, SUSPENSION

ENVELOPE = "v int, seq bigint, ts string, elapsed_ms bigint, session_id string, turn int, type string, data string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event envelopes from a folder of JSON lines as they arrive; at is the event's time."""
    return spark.readStream.schema(ENVELOPE).json(path).withColumn("at", F.try_to_timestamp("ts"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events by type in windows of event time; rows later than the watermark are dropped."""
    window = F.window("at", size, slide) if slide else F.window("at", size)
    return events.withWatermark("at", late).groupBy(window, "type").count().select("window.start", "window.end", "type", "count")


def active_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of activity: runs of events without a gap."""
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap), "session_id").count().select("session_id", "session_window.start", "session_window.end", "count")


def seconds_for(kind: str, status, retry_after) -> tuple[int, str] | None:
    """How long a failure suspends an engine, and why."""
    none = lambda x: x is None or x != x
    if kind == "challenge":
        out = SUSPENSION["challenge"], "challenge"
    elif kind == "upstream" and not none(retry_after):
        out = min(int(retry_after), LONGEST_SUSPENSION), "retry_after"
    elif kind == "upstream" and not none(status) and int(status) in (403, 429):
        out = SUSPENSION[f"http_{int(status)}"], f"http_{int(status)}"
    elif kind == "upstream" and not none(status) and 500 <= int(status) < 600:
        out = SUSPENSION["upstream"], "upstream"
    elif kind == "timeout":
        out = SUSPENSION["timeout"], "timeout"
    else:
        return None
    return out if out[0] > 0 else None
