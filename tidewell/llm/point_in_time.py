"""A feature table as of each sale: what was known about its client at that time.

Every event (click, sale, line of a sale) has the time at which it happened and the time from which it is available.
A window of d days before t holds the events with t - d < happened <= t that are available at t, so each window is a
dominance query on two axes: available <= t and happened > t - d.

Method: offline divide and conquer (CDQ). Points and queries of a client stand in the order of availability. At each
level of a binary tree over their places the points of a left half meet the queries of its right half, and there one
prefix sum in the order of happening answers them; every pair meets at one level. Spark's range exchange keeps a
client in one partition, where all this is done with sorted arrays, unless it is crowded (more than half a
partition). A crowded client is cut, and what its partition misses of those before it is a difference of sums: as
nothing is available before it happens, a window holds a point from its availability until happened + d, so each of
its points brings one more row, for its end, and partitions pass on what they have opened and not ended (carried).
No row is there once for each level, and no client is joined with itself.

Distinct items: an item counts at t if any of its lines does, i.e. inside the union of [available, happened + d). The
union is cut into disjoint intervals, and the number of them that hold t is a plain prefix sum of starts and ends.
Labels are prefix sums likewise, and the last click a prefix maximum.

Defined results: sales without client_id or sold_at give no row; repeated sales give a row each, and each brings its
lines. Events without client or times never count; amounts that are null or not finite count 0 cents. Clicks that
are equal in all seven columns are one. A null sale_id delays t by nothing and has no lines. Empty tables give
an empty result or zeros. Columns beside those named take no part. Times without a zone are UTC in any session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import few_samples, lean_batches, partitions, stored

#: Rows of a partition at most, on average.
ROWS = 400_000
SECOND = 1_000_000
DAY = 86_400 * SECOND
#: From ENDED on: the end of a point (kind ENDED + 3 * window + kind of the point).
CLICK, SALE, LINE, LABEL, ITEMS, QUERY, CHUNK, ENDED = range(8)
SUMS = ["n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents"]
AXIS = ["client", "at", "is_query", "kind", "ts", "n", "cents", "id"]
NONE = np.iinfo(np.int64).min


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is UTC, whatever the session's zone is."""
    at = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(at)
    clock = (F.hour(at) * 3600 + F.minute(at) * 60).cast("long")
    return F.unix_date(F.to_date(at)).cast("long") * DAY + clock * SECOND + (F.date_part(F.lit("SECOND"), at) * SECOND).cast("long")


def cents(name: str) -> Column:
    x = F.col(name) * F.lit(100.0) + F.lit(0.5)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0).otherwise(F.coalesce(F.floor(x), F.lit(0))).cast("long")


def _axis(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows of the axis of availability; what is not given is 0."""
    zero = F.lit(0).cast("long")
    given = {"is_query": F.lit(0).cast("byte"), "id": F.lit(None).cast("long")} | columns
    types = {"is_query": "byte", "kind": "byte"}
    return df.select(*[given.get(c, zero).cast(types.get(c, "long")).alias(c) for c in AXIS])


def _clicks(clicks: DataFrame, delay: int, longest: int) -> DataFrame:
    rows = clicks.select("click_id", micros(clicks, "ts").alias("ts"), micros(clicks, "arrived_at").alias("arrived"), "client_id", "kind", "value", F.unhex(F.md5("props")).alias("props"))
    rows = rows.where("client_id IS NOT NULL AND ts IS NOT NULL AND arrived IS NOT NULL").distinct().withColumn("at", F.greatest("ts", F.col("arrived") + delay)).where(F.col("at") < F.col("ts") + longest)
    return _axis(rows, client=F.col("client_id"), at=F.col("at"), kind=F.lit(CLICK), ts=F.col("ts"), n=F.coalesce((F.col("kind") == "purchase").cast("long"), F.lit(0)), cents=cents("value"), id=F.col("click_id"))


def _sales(sales: DataFrame, delay: int) -> DataFrame:
    """client, sale_id, sold, t, at (available; null: never), total."""
    rows = sales.select(F.col("client_id").alias("client"), "sale_id", micros(sales, "sold_at").alias("sold"), micros(sales, "arrived_at").alias("arrived"), cents("total").alias("cents"))
    late = F.coalesce(F.crc32(F.col("sale_id").cast("string")), F.lit(0)) % 259200
    return rows.where("client IS NOT NULL AND sold IS NOT NULL").select("client", "sale_id", "sold", (F.col("sold") + late * SECOND).alias("t"), F.when(F.col("arrived").isNotNull(), F.greatest("sold", F.col("arrived") + delay)).alias("at"), "cents")


def carried(chunks: DataFrame, keys: list[str], merge: dict[str, Callable[[str], Column]], n: int) -> DataFrame:
    """Of chunks (keys, pid, values) of at most n partitions: for each, the values of the chunks of its keys before it.

    A partition number is a sum of aligned blocks of 1, 2, 4, ... partitions, so each chunk needs the merged values of at
    most log(n) blocks: two aggregates and a join, no task sees all chunks of a key.
    """
    steps = F.sequence(F.lit(0), F.lit(max(1, (n - 1).bit_length()) - 1))
    merged = [f(c).alias(c) for c, f in merge.items()]
    blocks = chunks.select(*keys, "pid", *merge, F.explode(steps).alias("step")).groupBy(*keys, "step", F.expr("shiftright(pid, step)").alias("block")).agg(*merged)
    bits = F.filter(steps, lambda s: F.call_function("shiftright", F.col("pid"), s).bitwiseAND(F.lit(1)) == 1)
    needs = chunks.select(*keys, "pid").distinct().select(*keys, "pid", F.explode(bits).alias("step")).withColumn("block", F.expr("shiftright(pid, step) - 1"))
    return needs.join(blocks, [*keys, "step", "block"]).groupBy(*keys, "pid").agg(*merged)


def _columns(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


def _ints(table: pa.Table, name: str, null: int = 0) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(null).to_numpy(zero_copy_only=False)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """The number of the run of equal keys that each row is in."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _run_max(run: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Running maximum of ranks (0 and up; -1: none) within runs; -1 before the first."""
    size = int(rank.max(initial=0)) + 2
    return np.maximum.accumulate(run * size + rank + 1) - run * size - 1


def _some(value: np.ndarray, none: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.array(value, kind, mask=none)


# --- distinct items: disjoint intervals --------------------------------------------------------------------------

PIECES = "client long, item long, pid int, first boolean, kind byte, w int, at long, ts long, until long, n long, cents long"


def _pieces(windows: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by client, item, at -> the lines as points, the disjoint intervals of each item, and the latest ts of the first and last item of the partition."""
    table = _columns(batches)
    if table is None:
        return
    client, item, at, ts = (_ints(table, c, NONE) for c in ("client", "item", "at", "ts"))
    n, worth, pid = _ints(table, "n"), _ints(table, "cents"), int(table.column("pid")[0].as_py())
    run = _runs(client, item)
    edge = (run == 0) | (run == run[-1])

    def rows(kind, w, client, item, first, at, ts, until, n, worth):
        size = len(client)
        columns = [client, _some(item, item == NONE), np.full(size, pid, np.int32), first, np.full(size, kind, np.int8), np.full(size, w, np.int32), at, ts, until, n, worth]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

    zeros = np.zeros(len(client), np.int64)
    yield rows(LINE, 0, client, item, run == 0, at, ts, zeros, n, worth)
    for r in {0, int(run[-1])}:
        on = np.flatnonzero(run == r)[:1]
        yield rows(QUERY, 0, client[on], item[on], np.ones(1, bool), at[on], ts[run == r].max(keepdims=True), zeros[:1], zeros[:1], zeros[:1])
    for w, d in enumerate(windows):
        on = np.flatnonzero((item != NONE) & (at < ts + d))
        if not len(on):
            continue
        known, rank = np.unique(ts[on], return_inverse=True)
        best = _run_max(run[on], rank)
        latest = known[best]  # of this row and those before it
        same = np.zeros(len(on), dtype=bool)
        same[1:] = run[on][1:] == run[on][:-1]
        joined = same.copy()
        joined[1:] &= at[on][1:] <= latest[:-1] + d
        begins = np.flatnonzero(~joined)
        ends = np.append(begins[1:], len(on)) - 1
        pick = on[begins]
        yield rows(ITEMS, w, client[pick], item[pick], run[pick] == 0, at[pick], ts[pick], latest[ends] + d, zeros[: len(pick)], zeros[: len(pick)])


def _lines(lines: DataFrame, sales: DataFrame, windows: list[int], n: int) -> DataFrame:
    """Points of lines, and starts and ends of the disjoint intervals of items, as rows of the axis."""
    known = lines.select("sale_id", F.col("item_id").alias("item"), micros(lines, "shipped_at").alias("shipped"), cents("amount").alias("cents")).where("sale_id IS NOT NULL AND shipped IS NOT NULL")
    met = known.join(sales.where("at IS NOT NULL").select("sale_id", "client", F.col("sold").alias("ts"), F.col("at").alias("sale_at")), "sale_id")
    met = met.withColumn("at", F.greatest("sale_at", "shipped")).where(F.col("at") < F.col("ts") + max(windows))
    met = met.groupBy("client", "item", "at", "ts").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    dealt = met.repartitionByRange(n, "client", "item", "at", "ts").sortWithinPartitions("client", "item", "at", "ts").withColumn("pid", F.spark_partition_id())
    with few_samples(lines.sparkSession, n):
        pieces = stored(dealt.mapInArrow(lean_batches(partial(_pieces, windows)), PIECES), "pieces")
    points = _axis(pieces.where(F.col("kind") == LINE), **{c: F.col(c) for c in ("client", "at", "ts", "n", "cents", "kind")})
    ends = pieces.where((F.col("kind") == QUERY) & F.col("item").isNotNull()).groupBy("client", "item", "pid").agg(F.max("ts").alias("before"))
    before = carried(ends, ["client", "item"], {"before": F.max}, n)
    spans = pieces.where(F.col("kind") == ITEMS)
    # what an earlier partition covers of an interval is cut off; only the first item of a partition can have been there
    first = spans.where("first").join(before, ["client", "item", "pid"], "left")
    d = F.element_at(F.array(*[F.lit(x) for x in windows]), F.col("w") + 1)
    first = first.withColumn("at", F.greatest("at", F.col("before") + d)).where("at < until").drop("before")
    spans = spans.where("NOT first").unionByName(first)
    delta = F.explode(F.array(F.struct(F.col("at").alias("when"), F.lit(1).alias("by")), F.struct(F.col("until").alias("when"), F.lit(-1).alias("by"))))
    spans = spans.select("client", "w", delta.alias("x")).groupBy("client", "w", F.col("x.when").alias("at")).agg(F.sum("x.by").alias("n")).where("n <> 0")
    return points.unionByName(_axis(spans, client=F.col("client"), at=F.col("at"), kind=F.lit(ITEMS), ts=F.col("w"), n=F.col("n")))


# --- the levels inside a partition --------------------------------------------------------------------------------


def _result_columns(windows: list[int]) -> list[str]:
    return [f"{c}_{w}" for w in range(len(windows)) for c in SUMS] + [f"n_items_{w}" for w in range(len(windows))] + ["label"]


def _marks(windows: list[int]) -> str:
    return "edge boolean, pid int, client long, at long, kind byte, id long, last struct<ts:bigint,id:bigint>, " + ", ".join(f"{c} long" for c in _result_columns(windows))


def _payload(kind: np.ndarray, n: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """What a point adds to each of SUMS."""
    out = np.zeros((len(kind), len(SUMS)), np.int64)
    click, sale, line = (kind == k for k in (CLICK, SALE, LINE))
    out[:, 0], out[:, 1], out[:, 2] = click, click * n, click * worth
    out[:, 3], out[:, 4] = sale, sale * worth
    out[:, 5], out[:, 6] = line * n, line * worth
    return out


def dominance(run: np.ndarray, ts: np.ndarray, payload: np.ndarray, is_query: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For rows in order of availability: for each query the summed payload of the points of its run before it with ts > low.

    Level by level the points in the left half of a node meet the queries in its right half. Only the run that
    holds the middle of a node has both.
    """
    size = len(run)
    place = np.arange(size)
    if not size:
        return np.zeros(payload.shape, np.int64)
    run = _runs(run)
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    start, end = starts[run], np.append(starts[1:], size)[run]
    known = np.unique(ts[~is_query])
    rank = np.searchsorted(known, ts)
    floor = np.searchsorted(known, low, "right")
    out = np.zeros((size, payload.shape[1]), np.int64)
    wide = len(known) + 1
    for level in range(max(0, size - 1).bit_length()):
        half = 1 << level
        middle = (place >> (level + 1) << (level + 1)) + half
        right = (place & half).astype(bool)
        points = np.flatnonzero(~right & ~is_query & (middle < end))
        asks = np.flatnonzero(right & is_query & (start < middle))
        if not len(points) or not len(asks):
            continue
        key = (points >> (level + 1)) * wide + rank[points]
        order = np.argsort(key, kind="stable")
        key = key[order]
        sums = np.zeros((len(points) + 1, payload.shape[1]), np.int64)
        np.cumsum(payload[points[order]], axis=0, out=sums[1:])
        node = asks >> (level + 1)
        out[asks] += sums[np.searchsorted(key, (node + 1) * wide)] - sums[np.searchsorted(key, node * wide + floor[asks])]
    return out


def _swept(windows: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition sorted by client and availability -> its queries, answered from the partition, and the sums of its first and last client where they are crowded (kind CHUNK)."""
    table = _columns(batches)
    if table is None:
        return
    client, at, kind, ts, n, worth = (_ints(table, c) for c in ("client", "at", "kind", "ts", "n", "cents"))
    ids, pid = _ints(table, "id", NONE), int(table.column("pid")[0].as_py())
    crowd = table.column("crowd").combine_chunks().to_numpy(zero_copy_only=False)
    del table
    run = _runs(client)
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    ends = np.append(starts[1:], len(run))
    asks = np.flatnonzero(kind == QUERY)
    chunks = np.array([r for r in sorted({0, int(run[-1])}) if crowd[starts[r]]], np.int64)
    # a query looks at its run up to itself, a chunk at all of its run
    since, until = np.append(starts[run[asks]], starts[chunks]), np.append(asks, ends[chunks])

    def so_far(value: np.ndarray) -> np.ndarray:
        total = np.zeros((len(value) + 1, *value.shape[1:]), np.int64)
        np.cumsum(value, axis=0, out=total[1:])
        return total[until] - total[since]

    done = {"label": so_far(np.where(kind == LABEL, n, 0))}
    for w in range(len(windows)):
        done[f"n_items_{w}"] = so_far(np.where((kind == ITEMS) & (ts == w), n, 0))
    clicks = np.flatnonzero(kind == CLICK)
    clicks = clicks[np.lexsort((ids[clicks], ts[clicks]))]
    rank = np.full(len(run), -1)
    rank[clicks] = np.arange(len(clicks))
    last = _run_max(run, rank)[np.append(asks, ends[chunks] - 1)]
    has = last >= 0
    found = clicks[last[has]]
    last_ts, last_id = np.zeros(len(until), np.int64), np.full(len(until), NONE)
    last_ts[has], last_id[has] = ts[found], ids[found]
    del rank, clicks, last
    plane = np.flatnonzero((kind <= LINE) | (kind == QUERY))
    payload = _payload(kind[plane], n[plane], worth[plane])
    of_crowd = crowd[since]
    for w, d in enumerate(windows):
        sums = np.zeros((len(until), len(SUMS)), np.int64)
        sums[: len(asks)] = dominance(run[plane], ts[plane], payload, kind[plane] == QUERY, at[plane] - d)[kind[plane] == QUERY]
        if crowd.any():
            opened = _payload(np.where(at < ts + d, kind, QUERY), n, worth)
            ended = _payload(np.where((kind >= ENDED) & ((kind - ENDED) // 3 == w), (kind - ENDED) % 3, QUERY), n, worth)
            # beyond the partition's own points (sums) this is what the ones before it have lost by then
            lost = so_far(opened - ended) - sums
            sums[of_crowd] += lost[of_crowd]
            del opened, ended, lost
        done |= {f"{c}_{w}": sums[:, i] for i, c in enumerate(SUMS)}
    del payload

    size, place = len(until), np.append(asks, starts[chunks])
    edge = of_crowd & (run[place] == 0)
    kinds = np.append(np.full(len(asks), QUERY, np.int8), np.full(len(chunks), CHUNK, np.int8))
    struct = pa.StructArray.from_arrays([pa.array(last_ts), _some(last_id, last_id == NONE)], names=["ts", "id"], mask=pa.array(~has))
    columns = {"edge": edge, "pid": np.full(size, pid, np.int32), "client": client[place], "at": at[place], "kind": kinds, "id": _some(ids[place], ids[place] == NONE), "last": struct, **done}
    names = [x.split()[0] for x in _marks(windows).replace("struct<ts:bigint,id:bigint>", "struct").split(", ")]
    out = pa.table([columns[c] if isinstance(columns[c], pa.Array) else pa.array(np.ascontiguousarray(columns[c])) for c in names], names=names)
    yield from out.to_batches(max_chunksize=50_000)


# --- crowded clients ----------------------------------------------------------------------------------------------


def _crowded(axis: DataFrame, least: int) -> DataFrame:
    """Clients with more than so many rows: a few for each partition at most."""
    return stored(axis.groupBy("client").agg(F.sum("rows").alias("rows")).where(F.col("rows") > least), "crowded")


def _with_ends(axis: DataFrame, crowded: DataFrame, windows: list[int]) -> DataFrame:
    """axis with crowd (whether the client is crowded), and with the ends of the points of such clients."""
    flagged = axis.join(F.broadcast(crowded.select("client", F.lit(True).alias("crowd"))), "client", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    row = lambda at, kind: F.struct(at.alias("at"), kind.cast("byte").alias("kind"))
    point = F.col("crowd") & (F.col("kind") <= LINE)
    ends = [F.when(point & (F.col("at") < F.col("ts") + d), row(F.col("ts") + d, F.col("kind") + ENDED + 3 * w)) for w, d in enumerate(windows)]
    each = F.explode(F.filter(F.array(row(F.col("at"), F.col("kind")), *ends), lambda x: x.isNotNull()))
    return flagged.withColumn("x", each).withColumns({"at": F.col("x.at"), "kind": F.col("x.kind")}).select(*AXIS, "crowd")


def feature_table(sales: DataFrame, clicks: DataFrame, lines: DataFrame, days: tuple[int, ...] = (2, 14), label_days: int = 7, delay_minutes: int = 240, partition_count: int | None = None) -> DataFrame:
    """One row for each sale and window of d days: sale_id, d, t_us, label and the counts and sums of the window."""
    spark = sales.sparkSession
    windows, delay = [d * DAY for d in days], delay_minutes * 60 * SECOND
    # rows of the axis: a sale is a point, a query and two ends of its label; a line a point and up to two intervals
    rows = clicks.count() + 4 * sales.count() + 3 * lines.count()
    n = partition_count or max(partitions(spark), -(-rows // ROWS))
    sold = _sales(sales, delay)
    no = F.lit(0).cast("long")
    row = lambda at, kind, ts=no, n=no, worth=no, ident=no, ask=0: F.struct(at.alias("at"), F.lit(ask).cast("byte").alias("is_query"), F.lit(kind).cast("byte").alias("kind"), ts.alias("ts"), n.alias("n"), worth.alias("cents"), ident.alias("id"))
    one = F.lit(1).cast("long")
    own = F.array(
        row(F.when(F.col("at") < F.col("sold") + max(windows), F.col("at")), SALE, ts=F.col("sold"), worth=F.col("cents")),
        row(F.col("sold") - label_days * DAY, LABEL, n=one), row(F.col("sold"), LABEL, n=-one), row(F.col("t"), QUERY, ident=F.col("sale_id"), ask=1),
    )
    of_sales = sold.select("client", F.explode(own).alias("x")).select("client", "x.*").where("at IS NOT NULL").select(*AXIS)
    of_lines = _lines(lines, sold, windows, n)
    axis = reduce(DataFrame.unionByName, [_clicks(clicks, delay, max(windows)), of_sales, of_lines])
    by_client = [clicks.where("client_id IS NOT NULL").select(F.col("client_id").alias("client"), F.lit(1).alias("rows")), sold.select("client", F.lit(4).alias("rows")), of_lines.select("client", F.lit(1).alias("rows"))]
    crowded = _crowded(reduce(DataFrame.unionByName, by_client), max(1, rows // (2 * n)))
    crowd = crowded.agg(F.sum("rows")).first()[0]
    order = ["client", "at", "is_query"]
    if crowd:
        n = partition_count or max(n, -(-(rows + len(windows) * crowd) // ROWS))
        axis = _with_ends(axis, crowded, windows)
        # a client that is not crowded is one key of the exchange and so in one partition
        dealt = axis.repartitionByRange(n, "client", *[F.when(F.col("crowd"), c) for c in (F.col("at"), F.col("is_query"), F.xxhash64("kind", "ts", "id", "cents"))])
    else:
        dealt = axis.withColumn("crowd", F.lit(False)).repartitionByRange(n, "client")
    dealt = dealt.sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    with few_samples(spark, n):
        marks = stored(dealt.mapInArrow(lean_batches(partial(_swept, windows)), _marks(windows)), "marks")
    found = _result_columns(windows)
    answered = marks.where(F.col("kind") == QUERY).select("edge", "client", "pid", F.col("id").alias("sale_id"), F.col("at").alias("t_us"), "last", *found)
    if crowd:
        chunks = marks.where(F.col("kind") == CHUNK).select("client", "pid", "last", *found)
        before = carried(chunks, ["client"], {c: F.sum for c in found} | {"last": F.max}, n).withColumnsRenamed({c: f"b_{c}" for c in [*found, "last"]})
        reached = answered.where("edge").join(before, ["client", "pid"], "left")
        more = {c: F.col(c) + F.coalesce(f"b_{c}", no) for c in found} | {"last": F.greatest("last", "b_last")}
        answered = answered.where("NOT edge").unionByName(reached.withColumns(more).select(answered.columns))
    each = [F.struct(F.lit(d).alias("d"), F.when(F.col("last.ts") > F.col("t_us") - windows[w], F.col("last.id")).alias("last_click_id"), F.col(f"n_items_{w}").alias("n_items"), *[F.col(f"{c}_{w}").alias(c) for c in SUMS]) for w, d in enumerate(days)]
    out = answered.select("sale_id", "t_us", (F.col("label") > 0).alias("label"), F.explode(F.array(*each)).alias("x"))
    return out.select("sale_id", "x.d", "t_us", "label", *[f"x.{c}" for c in ("n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")])
