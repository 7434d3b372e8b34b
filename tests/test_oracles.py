"""Every query with SQL gives DuckDB's rows, whatever the number of shuffle partitions."""

import math
import os

import duckdb
import pytest

from tidewell.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    result = duck.execute(plans.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(x[0] for x in result.description)
    assert got == rows([x[0] for x in result.description], result.fetchall())


@pytest.mark.parametrize("name", ["fused_hits", "paired_comparison", "engine_suspensions", "kept_history"])
def test_partitions_do_not_matter(spark, name):
    out = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = plans.QUERIES[name](spark, SF)
        out.append(rows(df.columns, df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
