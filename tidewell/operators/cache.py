"""Cached lookups as of a time, and eviction by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import SLICE, running_sum, sliced


def ttl(recency: Column, normal: int = 86_400, day: int = 3_600) -> Column:
    """Seconds that an entry lives: less for results of the last day."""
    return F.when(recency == "d", day).otherwise(normal)


def lookup(lookups: DataFrame, stores: DataFrame, keys: list[str], ttl_seconds: Column | int) -> DataFrame:
    """lookups (ts, ordinal) with stored_ts and payload of the latest store of their key at or before them, null beyond the time to live.

    A union and one window: a single shuffle on the key whatever the number of stores for a lookup. Of stores
    at one time the last ordinal counts. ts in seconds or as a timestamp.
    """
    timed = dict(stores.dtypes)["ts"].startswith("timestamp")

    def seconds(c: str) -> Column:
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(c).cast("timestamp_ntz")) / 1_000_000 if timed else F.col(c)

    left = lookups.withColumn("_side", F.lit(1)).withColumn("_store", F.lit(None).cast(f"struct<at:{dict(stores.dtypes)['ts']},payload:{dict(stores.dtypes)['payload']}>"))
    right = stores.select(*keys, "ts", "ordinal", F.lit(0).alias("_side"), F.struct(F.col("ts").alias("at"), "payload").alias("_store"))
    window = Window.partitionBy(*keys).orderBy("ts", "_side", "ordinal")
    out = left.unionByName(right, allowMissingColumns=True).withColumn("_found", F.last("_store", ignorenulls=True).over(window)).where("_side = 1")
    age = seconds("ts") - seconds("_found.at")
    fresh = age <= (F.lit(ttl_seconds) if isinstance(ttl_seconds, int) else ttl_seconds)
    return out.withColumn("stored_ts", F.when(fresh, F.col("_found.at"))).withColumn("payload", F.when(fresh, F.col("_found.payload"))).drop("_side", "_store", "_found")


def storable(entries: DataFrame, enabled: bool = True) -> DataFrame:
    """Entries (results array) that are worth storing."""
    return entries.where(F.size("results") > 0) if enabled else entries.limit(0)


def evict(files: DataFrame, cap: int, by: list[str] | None = None, keep: Column | None = None, width: int = 3600) -> DataFrame:
    """files (path, at, bytes) with evicted: oldest first until the rest fits; a null time is oldest; kept files weigh but never go.

    Without `by` all files are one store; either way a running sum goes over slices of `width` seconds.
    """
    by = by or []
    kept = F.lit(False) if keep is None else keep
    out = files.withColumn("_weight", F.when(kept, F.lit(0)).otherwise(F.coalesce("bytes", F.lit(0)))).withColumn("_one", F.lit(1))
    keys = [*by, "_one"]
    out = running_sum(sliced(out, "at", width), keys, F.col("_weight"), "_freed", F.asc_nulls_first("at"), "path")
    total = files.withColumn("_one", F.lit(1)).groupBy(*keys).agg(F.sum("bytes").alias("_total")).withColumnsRenamed({c: f"{c}_k" for c in keys})
    out = out.join(total, [out[c].eqNullSafe(total[f"{c}_k"]) for c in keys]).drop(*[f"{c}_k" for c in keys])
    return out.withColumn("evicted", ~kept & (F.col("_total") - (F.col("_freed") - F.col("_weight")) > cap)).drop(SLICE, "_weight", "_freed", "_one", "_total")


def stale_temporary(files: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    return files.where(F.col("path").rlike(r"\.tmp[^/]*$") & (now - F.col("at") > seconds))
