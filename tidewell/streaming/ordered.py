"""Folds over streams whose rows come in any order: a row counts when the watermark has passed its time.

A stream has the columns key, at (timestamp), rank, seq and row (JSON text). Keys are dealt by hash into BUCKETS groups,
so that a call of the state store serves many keys. The rows of a bucket wait in list state as packed tables; an
event-time timer releases those that the watermark has passed, in the order of (at, rank, seq) of each key, to a Fold,
which keeps a small state as JSON and may ask to be woken at later times. Waiting rows stay packed columns until they
are folded, a few thousand at a time, so that a key with millions of rows takes tens of bytes for each. So results do not
depend on how a stream is cut into batches, nor on the order of rows within the watermark. Rows later than the
watermark are left out, and rows without a time or before 1970 (where Spark's watermark starts).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Groups of keys: part of a checkpoint, so it does not follow the session's partitions.
BUCKETS = 1024
#: Rows that are Python objects at once.
STEP = 10_000
#: Times are in microseconds, timers in milliseconds.
WAITING = pa.schema([("key", pa.large_string()), ("at", pa.int64()), ("rank", pa.int32()), ("seq", pa.int64()), ("row", pa.large_string())])
ORDER = [(name, "ascending") for name in WAITING.names]
OUT = "key string, at long, seq long, out string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """What a key keeps and gives. State is a dict that JSON can hold; None is the state of a key not seen."""

    def start(self) -> dict:
        return {}

    def step(self, state: dict, at: int, seq: int, row: dict) -> list[dict]:
        """One row in order, which is not to be changed; gives rows."""
        raise NotImplementedError

    def wake(self, state: dict) -> int | None:
        """When the state changes by itself, if it does."""
        return None

    def woken(self, state: dict, at: int) -> list[dict]:
        """That time has come; gives rows and changes the state."""
        return []

    def over(self, state: dict) -> bool:
        """Nothing needs to be kept any more."""
        return not state


_parsed = lru_cache(4096)(json.loads)


def fold_rows(fold: Fold, state: dict, rows: list[tuple[int, int, int, str]], until: int) -> list[tuple[int, int, dict]]:
    """Rows in order and wakings up to a time; a waking comes before a row of the same time."""
    out = []

    def wake(limit: int) -> None:
        while (at := fold.wake(state)) is not None and at <= limit:
            out.extend((at, -1, x) for x in fold.woken(state, at))

    for at, _, seq, row in rows:
        wake(at)
        out += [(at, seq, x) for x in fold.step(state, at, seq, _parsed(row))]
    wake(until)
    return out


def _timer(at: int) -> int:
    return -(-at // 1000)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _name(key: str | None) -> str:
    """A key as a name in JSON, where a name cannot be null."""
    return "" if key is None else f"={key}"


def _key(name: str) -> str | None:
    return name[1:] if name else None


class Ordered(StatefulProcessor):
    """The folds of a bucket of keys. waiting: packed tables of rows; state: a JSON object of states (as JSON texts) by key."""

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        first = None
        for part in rows:
            if len(part):
                columns = [part[c] for c in ("key", "us", "rank", "seq", "row")]
                self.waiting.appendValue((_packed(pa.table([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, WAITING, strict=True)], WAITING)),))
                least = int(part["us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(max(_timer(first), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def _held(self, now: int) -> tuple[pa.Table | None, pa.Table | None]:
        """Waiting rows: those that are due, in order, and the later ones."""
        if not self.waiting.exists():
            return None, None
        held = pa.concat_tables([_unpacked(bytes(x[0])) for x in self.waiting.get()])
        is_due = pc.less_equal(held["at"], now)
        due, later = held.filter(is_due), held.filter(pc.invert(is_due))
        del held
        return due.sort_by(ORDER), later

    def _folded(self, due: pa.Table | None, states: dict[str, str], now: int, wakes: list[int]) -> Iterator[tuple]:
        """Rows (key, at, seq, out); changes states, and notes when they are to be woken."""

        def begun(name: str) -> dict:
            return json.loads(states.pop(name)) if name in states else self.fold.start()

        def ended(name: str, state: dict) -> None:
            if not self.fold.over(state):
                states[name] = json.dumps(state)
            if (at := self.fold.wake(state)) is not None:
                wakes.append(at)

        asleep, last, state = list(states), None, {}
        done: set[str] = set()
        for first in range(0, due.num_rows if due is not None else 0, STEP):
            some = due.slice(first, STEP)
            rows = zip(*[some.column(c).to_pylist() for c in WAITING.names], strict=True)
            for key, own in itertools.groupby(rows, key=lambda x: x[0]):
                if _name(key) != last:
                    if last is not None:
                        yield from ((_key(last), *x) for x in fold_rows(self.fold, state, [], now))
                        ended(last, state)
                    last = _name(key)
                    state = begun(last)
                    done.add(last)
                part = [x[1:] for x in own]
                yield from ((key, *x) for x in fold_rows(self.fold, state, part, part[-1][0]))
        if last is not None:
            yield from ((_key(last), *x) for x in fold_rows(self.fold, state, [], now))
            ended(last, state)
        for name in asleep:
            if name not in done:
                state = begun(name)
                yield from ((_key(name), *x) for x in fold_rows(self.fold, state, [], now))
                ended(name, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = 1000 * max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due, later = self._held(now)
        states, wakes = json.loads(self.state.get()[0]) if self.state.exists() else {}, []
        found = self._folded(due, states, now, wakes)
        while some := list(itertools.islice(found, STEP)):
            keys, ats, seqs, outs = zip(*some, strict=True)
            yield pd.DataFrame({"key": keys, "at": ats, "seq": seqs, "out": [json.dumps(x) for x in outs]})
        if due is not None and due.num_rows:
            if later.num_rows:
                self.waiting.put([(_packed(later),)])
            else:
                self.waiting.clear()
        self._keep(states)
        again = wakes + ([pc.min(later["at"]).as_py()] if later is not None and later.num_rows else [])
        if again:
            self.handle.registerTimer(_timer(min(again)))

    def _keep(self, states: dict[str, str]) -> None:
        if states:
            self.state.update((json.dumps(states),))
        else:
            self.state.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802
        states = json.loads(self.state.get()[0]) if self.state.exists() else {}
        given = {_name(k): s for k, s in zip(initialState["key"], initialState["state"], strict=True)}
        self._keep(states | given)
        wakes = [at for s in given.values() if (at := self.fold.wake(json.loads(s))) is not None]
        if wakes:
            self.handle.registerTimer(max(_timer(min(wakes)), 1))

    def close(self) -> None:
        pass


def within_pandas(at: str) -> Column:
    """Times as Python workers can hold them; broken ones far off go to the ends of that range."""
    return F.greatest(F.least(F.col(at), F.lit("2262-01-01").cast("timestamp")), F.lit("1678-01-01").cast("timestamp"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")


def folded(stream: DataFrame, fold: Fold, late: str, result: str, initial: DataFrame | None = None) -> DataFrame:
    """stream (key, at timestamp, rank, seq, row) -> key, at (us), seq (-1: of no row) and the columns of result.

    initial (key, state as JSON): what keys had before the stream.
    """
    timed = stream.withColumn("at", within_pandas("at")).where("at IS NOT NULL AND row IS NOT NULL").withWatermark("at", late)
    timed = timed.select("key", "at", F.unix_micros("at").alias("us"), F.coalesce(F.col("rank").cast("int"), F.lit(0)).alias("rank"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), "row").withColumn("bucket", _bucket()).groupBy("bucket")
    start = initial.select("key", "state", _bucket().alias("bucket")).groupBy("bucket") if initial is not None else None
    out = timed.transformWithStateInPandas(Ordered(fold), OUT, "Append", "EventTime", start)
    return out.withColumn("out", F.from_json("out", result)).select("key", "at", "seq", "out.*")


def run_to_end(slices: list[DataFrame], transform: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """The rows of a streaming query that is started once for each slice, on one checkpoint, and reads all there is.

    folder: shared by driver and executors; it gets the slices, the checkpoint and the result. State is kept in RocksDB.
    """
    spark: SparkSession = slices[0].sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        for part in slices:
            part.write.mode("append").parquet(f"{folder}/in")
            stream = transform(spark.readStream.schema(part.schema).parquet(f"{folder}/in"))
            query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            if query.exception():
                raise query.exception()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def kept_states(spark: SparkSession, folder: str, name: str = "state") -> DataFrame:
    """What a query of run_to_end still keeps in one of its value states: key and the state's columns; of states by name in JSON (column state) a row for each key."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        rows = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", name).load()
        if rows.schema["value"].dataType.fieldNames() == ["state"]:
            each = rows.select(F.explode(F.from_json("value.state", "map<string,string>")).alias("name", "state"))
            return each.select(F.when(F.col("name") != "", F.substring("name", 2, 2**31 - 1)).alias("key"), "state")
        return rows.select(F.col(f"key.{rows.schema['key'].dataType.fieldNames()[0]}").alias("key"), "value.*")
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
