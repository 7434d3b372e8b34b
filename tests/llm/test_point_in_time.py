"""The feature table against a direct count over all events, with hot clients over many partitions and odd rows."""

import datetime as dt
import math
import random
import zlib

import numpy as np
import pytest

from tidewell.llm import point_in_time as P

BASE = dt.datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, pid int, label string"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, at long, kind string"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, client long, n int"


def tables():
    r = random.Random(4)
    when = lambda: None if r.random() < 0.03 else BASE + dt.timedelta(hours=r.randrange(0, 40 * 24), microseconds=r.choice([0, 0, 1, 999_999]))
    late = lambda t: None if t is None or r.random() < 0.03 else t + dt.timedelta(minutes=r.choice([0, 0, 5, 300, 4000, 30_000]))
    client = lambda: r.choice([7] * 8 + [1, 2, 3, -4, None])
    money = lambda: r.choice([None, 0.0, 1.005, -3.335, 19.99, 250.5, math.nan, math.inf])
    clicks, sales, lines = [], [], []
    for i in range(500):
        t = when()
        clicks.append((r.choice([i, i, None]), t, late(t), client(), r.choice(["purchase", "view", None]), money(), r.choice(['{"k": 1}', None])))
    clicks += r.sample(clicks, 60)
    for i in range(160):
        t = when()
        sales.append((r.choice([i] * 20 + [None]), client(), "done", money(), t, late(t), 1))
    sales += sales[:5]
    for i in range(900):
        sale = r.choice([7, 7, 7, None, *range(160)])
        lines.append((sale, 1, r.choice([1, 1, 1, 2, 3, 4, None]), 1, 1, money(), 0.0, "x", when()))
    lines += lines[:40]
    return clicks, sales, lines


def us(t):
    return None if t is None else int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def worth(x):
    return 0 if x is None or math.isnan(x) or math.isinf(x) else math.floor(100 * x + 0.5)


def expected(clicks, sales, lines, days=(2, 14)):
    clicks = {tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in c): c for c in clicks}.values()
    out, ready = [], 240 * 60_000_000
    for sid, cid, _, _, sold, _, _ in sales:
        if cid is None or sold is None:
            continue
        t = us(sold) + (zlib.crc32(str(sid).encode()) if sid is not None else 0) % 259200 * 1_000_000
        mine = [s for s in sales if s[1] == cid and s[4] is not None]
        label = any(t < us(s[4]) <= t + 7 * P.DAY for s in mine)
        for d in days:
            inside = lambda ts, arrived: ts is not None and arrived is not None and t - d * P.DAY < us(ts) <= t and us(arrived) + ready <= t  # noqa: B023, E731
            c = [x for x in clicks if x[3] == cid and inside(x[1], x[2])]
            s = [x for x in mine if inside(x[4], x[5])]
            ln = [x for o in s for x in lines if o[0] is not None and x[0] == o[0] and x[8] is not None and us(x[8]) <= t]
            last = max(c, key=lambda x: (x[1], -(1 << 63) if x[0] is None else x[0]))[0] if c else None
            out.append((sid, d, t, label, len(c), sum(x[4] == "purchase" for x in c), sum(worth(x[5]) for x in c), last, len(s), sum(worth(x[3]) for x in s), len(ln), len({x[2] for x in ln} - {None}), sum(worth(x[5]) for x in ln)))
    return out


def frames(spark, clicks, sales, lines):
    return [spark.createDataFrame([(*x, *more) for x in rows], schema).repartition(3) for rows, schema, more in ((sales, SALES, (1, "k")), (clicks, CLICKS, (1, "x")), (lines, LINES, (1, 2)))]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 13])
def test_same_as_counting(spark, n):
    data = tables()
    assert ordered(P.feature_table(*frames(spark, *data), partition_count=n).collect()) == ordered(expected(*data))


def test_other_zone_and_windows(spark):
    data = [x[:120] for x in tables()]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = P.feature_table(*frames(spark, *data), days=(1, 5, 30), partition_count=5).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert ordered(got) == ordered(expected(*data, days=(1, 5, 30)))


def test_empty(spark):
    sales, clicks, lines = frames(spark, *tables())
    assert P.feature_table(sales.where("false"), clicks, lines).count() == 0
    got = P.feature_table(sales, clicks.where("false"), lines.where("false")).collect()
    assert got and all(r.n_clicks == r.n_lines == r.n_items == 0 and r.last_click_id is None for r in got) and any(r.n_sales for r in got)


def test_dominance():
    r = np.random.default_rng(1)
    for size in (0, 1, 2, 37, 400):
        run, ts = np.sort(r.integers(0, 4, size)), r.integers(0, 20, size)
        asks, low = r.random(size) < 0.3, r.integers(-1, 21, size)
        pay = r.integers(0, 5, (size, 3)) * ~asks[:, None]
        got = P.dominance(run, ts, pay, asks, low)
        for j in np.flatnonzero(asks):
            on = [i for i in range(j) if not asks[i] and run[i] == run[j] and ts[i] > low[j]]
            assert (got[j] == pay[on].sum(axis=0)).all()


@pytest.mark.parametrize("n", [2, 13])
def test_a_row_for_each_query_whatever_a_client_has(spark, monkeypatch, n):
    made, stored = {}, P.stored

    def counted(df, name):
        out = stored(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(P, "stored", counted)
    data = tables()
    assert ordered(P.feature_table(*frames(spark, *data), partition_count=n).collect()) == ordered(expected(*data))
    queries = sum(s[1] is not None and s[4] is not None for s in data[1])
    assert sum(v for k, v in made.items() if k != "pieces") <= queries + 3 * n  # no rows for levels, nor those of a cut client once more


def test_small_clients_are_not_cut(spark, monkeypatch):
    clicks, sales, lines = tables()
    of = lambda rows, at: [(*x[:at], i % 40, *x[at + 1 :]) for i, x in enumerate(rows)]
    data = of(clicks, 3), of(sales, 1), lines
    made, stored = {}, P.stored

    def counted(df, name):
        out = stored(df, name)
        made[name] = out.where("edge OR kind = 6").count() if name == "marks" else out.count()
        return out

    monkeypatch.setattr(P, "stored", counted)
    assert ordered(P.feature_table(*frames(spark, *data), partition_count=3).collect()) == ordered(expected(*data))
    assert made["crowded"] == made["marks"] == 0
