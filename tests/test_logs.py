"""Logs: lines are numbered whatever tasks read them, and a batch that is written again is there once."""

import pytest
from pyspark.sql import functions as F

from tidewell.sources import readers, sinks


def test_lines_of_a_split_file(spark, tmp_path):
    want = {}
    for name, n in (("big.jsonl", 5000), ("small.jsonl", 3), ("empty.jsonl", 0)):
        rows = [f"{name} {i} " + "x" * (i * 37 % 90) if i % 11 else "" for i in range(n)]
        (tmp_path / name).write_text("".join(r + "\n" for r in rows))
        want |= {(name, i + 1): r for i, r in enumerate(rows)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        out = readers.lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = {(r.file.rsplit("/", 1)[1], r.line): r.value for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_error_rows_say_where(spark, tmp_path):
    good = '{"kind":"header","format_version":2,"session_id":"s"}'
    (tmp_path / "log.jsonl").write_text((good + "\n") * 400 + "{broken\n" + (good + "\n") * 400)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = readers.session_rows(spark, str(tmp_path / "log.jsonl")).where("error IS NOT NULL").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.line, r.error) for r in rows] == [(401, "line 401: not JSON")]


def events(spark, tmp_path, name, n):
    spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("seq"), F.when(F.col("id") % 5 == 0, "model.delta").otherwise("turn.started").alias("type")).repartition(2).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema("session_id string, seq long, type string").parquet(str(tmp_path / name))


def test_a_batch_run_again_is_stored_once(spark, tmp_path):
    stream, out = events(spark, tmp_path, "in", 50), f"{tmp_path}/log"
    write, failed = sinks.session_sink(out), []

    def crash_once(batch, batch_id):
        write(batch, batch_id)
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("lost before the commit")

    def start(f):
        query = stream.writeStream.foreachBatch(f).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(120)

    with pytest.raises(Exception, match="lost before the commit"):
        start(crash_once)
    start(crash_once)
    events(spark, tmp_path, "in", 10)
    start(sinks.session_sink(out))
    found = [r.seq for r in readers.json_lines(spark, out, "session_id string, seq long, type string").collect()]
    assert sorted(found) == sorted([i for i in range(50) if i % 5] + [i for i in range(10) if i % 5])


def test_paths_that_cannot_be_written(spark, tmp_path):
    (tmp_path / "file").write_text("in the way")
    batch = spark.createDataFrame([("s", 1, "turn.started")], "session_id string, seq long, type string")
    with pytest.raises(Exception):  # noqa: B017
        sinks.session_sink(f"{tmp_path}/file", explicit=True)(batch, 0)
    quiet = sinks.session_sink(f"{tmp_path}/file", explicit=False)
    quiet(batch, 0)
    quiet(batch, 1)
