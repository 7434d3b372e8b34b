"""Running values over long logs with few keys, in as many tasks as a log has slices of time.

A plain window over a key puts all its rows into one task. Here rows are dealt by key and slice of time. A first
window runs inside each slice; what a slice does to a running value is one small row (its sum, its maximum, what it
leaves behind); a window over these rows tells each slice what it starts with, and the rows of the slice take that up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Width of a slice in the unit of the time column (an hour of milliseconds).
WIDTH = 3_600_000
SLICE = "_slice"


def sliced(rows: DataFrame, time: str, width: int = WIDTH) -> DataFrame:
    """rows with the slice they belong to: `width` units of a number, an hour of a timestamp; rows without a time come first."""
    at = F.col(time)
    timed = dict(rows.dtypes)[time].startswith("timestamp")
    number = F.unix_date(F.to_date(at)) * 24 + F.hour(at) if timed else F.floor(at / width)
    return rows.withColumn(SLICE, F.coalesce(number.cast("long"), F.lit(-(1 << 62))))


def inside(by: list[str], *order) -> WindowSpec:
    return Window.partitionBy(*by, SLICE).orderBy(*order)


def earlier(by: list[str]) -> WindowSpec:
    """Over the small rows of slices: those before each."""
    return Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, by: list[str], left: dict[str, Column], start: dict[str, Column]) -> DataFrame:
    """rows with what their slice starts with. left: aggregates that say what a slice leaves; start: windows over those."""
    small = rows.groupBy(*by, SLICE).agg(*[v.alias(k) for k, v in left.items()])
    small = small.select(*by, SLICE, *[v.alias(k) for k, v in start.items()]).withColumnsRenamed({c: f"{c}_k" for c in [*by, SLICE]})
    on = [rows[c].eqNullSafe(small[f"{c}_k"]) for c in by] + [rows[SLICE] == small[f"{SLICE}_k"]]
    return rows.join(small, on).drop(*[f"{c}_k" for c in [*by, SLICE]])


def running_sum(rows: DataFrame, by: list[str], value: Column, name: str, *order) -> DataFrame:
    """rows (sliced) with the sum of value over the rows of their key up to and with them."""
    out = rows.withColumn("_value", value)
    out = out.withColumn("_here", F.sum("_value").over(inside(by, *order).rowsBetween(Window.unboundedPreceding, 0)))
    out = carried(out, by, {"_sum": F.sum("_value")}, {"_before": F.coalesce(F.sum("_sum").over(earlier(by)), F.lit(0))})
    return out.withColumn(name, F.coalesce("_here", F.lit(0)) + F.col("_before")).drop("_value", "_here", "_before")
