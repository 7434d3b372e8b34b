"""Sinks: append-only JSON logs and tapes, batch and streaming. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cache import storable

log = logging.getLogger(__name__)


def append_json(rows: DataFrame, path: str, compression: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.option("compression", compression) if compression else writer).json(path)


def store_cache(entries: DataFrame, path: str, enabled: bool = True) -> None:
    append_json(storable(entries, enabled), path)


def record_tape(rows: DataFrame, path: str) -> None:
    append_json(rows, path)


def stored_events(events: DataFrame) -> DataFrame:
    """What the session log keeps: everything but streamed text."""
    return events.where(F.col("type") != "model.delta")


def shown_events(events: DataFrame, detail: str = "default") -> DataFrame:
    """What a listener sees: streamed text only at the detail of tokens."""
    return events if detail == "tokens" else stored_events(events)


QUERY_ID = "sql.streaming.queryId"


def session_sink(path: str, explicit: bool = True, writer: str | None = None):
    """A foreachBatch function that stores each batch once, in a folder of its own under path.

    The folder is named after the streaming query (or `writer`) and the batch, so a batch that is run again after a crash
    between its write and its commit replaces what it wrote before; other queries on the same path have other names. An
    explicit path's error ends the query; a default path warns once and stops writing.
    """
    state = {"off": False}

    def write(batch: DataFrame, batch_id: int) -> None:
        if state["off"]:
            return
        name = writer or batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID) or "log"
        try:
            stored_events(batch).write.mode("overwrite").json(f"{path}/{name}-{batch_id:012d}")
        except Exception:
            if explicit:
                raise
            state["off"] = True
            log.warning("session log %s cannot be written; it is off for this run", path, exc_info=True)

    return write
