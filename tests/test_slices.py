"""Running values in slices are those of one window over everything, at any width."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import cache, governor

SCHEMA = "engine string, ts long, ordinal long, kind string, status int, retry_after long"
WIDTHS = [1, 1000, 70_000, 1 << 40]


@pytest.fixture(scope="module")
def log(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(0, 300) * 997, i, r.choice(["ok", "upstream", "challenge", "upstream"]), r.choice([403, 503, 429, 404, None]), r.choice([None, None, 5, 9000])) for i in range(400)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("width", WIDTHS)
def test_suspensions(log, width):
    rows = sorted(log.collect(), key=lambda x: (x.ts, x.ordinal))
    want, now = {}, {}
    for x in rows:
        if x.kind == "ok":
            now.pop(x.engine, None)
        seconds = {"challenge": (3600, "challenge")}.get(x.kind)
        if x.kind == "upstream":
            seconds = (min(x.retry_after, 3600), "retry_after") if x.retry_after is not None else {403: (180, "http_403"), 429: (180, "http_429"), 503: (30, "upstream")}.get(x.status)
        if seconds and (x.engine not in now or x.ts + seconds[0] * 1000 > now[x.engine][0]):
            now[x.engine] = (x.ts + seconds[0] * 1000, seconds[1])
        want[x.ordinal] = now.get(x.engine, (None, None))
    assert {x.ordinal: (x.until, x.reason) for x in governor.suspensions(log, width=width).collect()} == want


@pytest.mark.parametrize("width", WIDTHS)
def test_pacing_slots_budgets(spark, log, width):
    log = log.where("engine IS NOT NULL")
    order = Window.partitionBy("engine").orderBy("ts", "ordinal")
    rows = log.withColumn("before", F.lag("ts").over(order)).withColumn("n", F.row_number().over(order)).collect()
    wait = {x.ordinal: 0 if x.before is None else max(0, 2000 - (x.ts - x.before)) for x in rows}
    assert {x.ordinal: x.wait_ms for x in governor.pacing(log, 2000, width=width).collect()} == wait
    slot, last = {}, {}
    for x in sorted(rows, key=lambda x: (x.ts, x.ordinal)):
        slot[x.ordinal] = last[x.engine] = max(x.ts, last.get(x.engine, -(10**9)) + 1500)
    assert {x.ordinal: x.slot for x in governor.slots(log, 1500, width=width).collect()} == slot
    caps = spark.createDataFrame([("a", 100), ("b", 7)], "engine string, request_cap int")
    got = governor.budgets(log.withColumn("run", F.lit(1)), caps, ["run"], width=width).collect()
    assert {x.ordinal: x.throttled for x in got} == {x.ordinal: x.n > {"a": 100, "b": 7}[x.engine] for x in rows}


@pytest.mark.parametrize("width", WIDTHS)
def test_in_flight(spark, width):
    r = random.Random(2)
    rows = [(r.choice("ab"), s := r.randrange(0, 500), s + r.randrange(0, 60)) for _ in range(200)]
    frame = spark.createDataFrame(rows, "engine string, start long, end long")
    want = []
    for e in "ab":
        n = 0
        for ts, step in sorted([(s, 1) for x, s, _ in rows if x == e] + [(t, -1) for x, _, t in rows if x == e]):
            n += step
            want.append((e, ts, step))
    got = governor.overlaps(frame, -1000, width=width).collect()
    assert sorted((x.engine, x.ts, x.step) for x in got) == sorted(want)
    for x in got:
        events = [(s, 1) for e, s, _ in rows if e == x.engine] + [(t, -1) for e, _, t in rows if e == x.engine]
        assert x.in_flight == sum(step for ts, step in events if (ts, step) <= (x.ts, x.step))


@pytest.mark.parametrize("by", [None, ["store"]])
@pytest.mark.parametrize("width", [1, 50, 1 << 30])
def test_evict(spark, by, width):
    r = random.Random(3)
    files = [(r.choice("xy"), f"p{i}", r.choice([None, *range(100)]), r.randrange(0, 50)) for i in range(120)]
    frame = spark.createDataFrame(files, "store string, path string, at long, bytes long")
    gone = set()
    for store in ["x", "y"] if by else [None]:
        mine = sorted((f for f in files if store in (None, f[0])), key=lambda f: (f[2] is not None, f[2] or 0, f[1]))
        left = sum(f[3] for f in mine)
        for f in mine:
            if left > 900:
                gone.add(f[1])
            left -= f[3]
    assert {x.path for x in cache.evict(frame, 900, by, width=width).where("evicted").collect()} == gone
