"""Queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r9(c):
    return F.round(c, 9)


def literal(value) -> str:
    """A Python value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def _column(value, kind: str) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(x) for x in value]).cast(kind)
    return F.lit(value).cast(kind)


def cases(inputs: str, outputs: str, rows: list[tuple]):
    """A query that gives every event one of the cases, by event_id, and works out its outputs.

    rows hold the inputs and then the outputs that the rules demand: Spark is given the inputs only, the SQL the
    outputs only. The function takes a frame of event_id and the inputs and returns one with the outputs.
    """
    given = [x.strip().split(" ", 1) for x in inputs.split(";")]
    wanted = [x.strip().split(" ", 1) for x in outputs.split(";")]
    n = len(given)
    listed = ", ".join("(" + ", ".join([str(nr), *map(literal, row[n:])]) + ")" for nr, row in enumerate(rows))
    names = ", ".join(f'"{name}"' for name, _ in wanted)
    cast = ", ".join(f'CAST("{name}" AS {SQL_TYPES[kind]}) AS "{name}"' for name, kind in wanted)
    sql = f"WITH c(nr, {names}) AS (VALUES {listed}) SELECT event_id, {cast} FROM events JOIN c ON event_id % {len(rows)} = nr"

    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            case = F.array(*[F.struct(*[_column(v, kind).alias(name) for v, (name, kind) in zip(row[:n], given, strict=True)]) for row in rows])
            events = table(spark, folder, "events").select("event_id", F.element_at(case, (F.col("event_id") % len(rows) + 1).cast("int")).alias("c"))
            out = f(events.select("event_id", "c.*"))
            return out.select("event_id", *[F.col(name).cast(kind).alias(name) for name, kind in wanted])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(sql)(run)

    return add
