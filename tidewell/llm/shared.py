"""Where jobs of this subpackage keep intermediate tables, and how many partitions they use."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the keys that a range exchange samples to the driver for each partition, and how many it takes here.
SAMPLES, LEAST_SAMPLES, ALL_SAMPLES = "spark.sql.execution.rangeExchange.sampleSizePerPartition", 15, 3000


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder that the session names in spark.checkpoint.dir.

    Only where that setting is absent and Spark runs on this machine alone (local tests) a folder of the machine
    is used; on a cluster without a shared folder this raises, as executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark._jsc.sc().getCheckpointDir()
        if not given.isDefined() and not spark._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = given.get() if given.isDefined() else f"file://{tempfile.gettempdir()}/tidewell"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    Once it is written nobody needs the shuffle files behind it, so they go at once and not when the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def few_samples(spark: SparkSession, n: int) -> Iterator[None]:
    """While this is open, a range exchange over n partitions sends about ALL_SAMPLES keys to the driver, not 100 a partition."""
    before = spark.conf.get(SAMPLES, None)
    spark.conf.set(SAMPLES, str(max(LEAST_SAMPLES, min(100, ALL_SAMPLES // n))))
    try:
        yield
    finally:
        spark.conf.unset(SAMPLES) if before is None else spark.conf.set(SAMPLES, before)


def _libc():
    try:
        trim = ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: freed memory is its own affair
        return lambda _: 0
    return trim


_trim = _libc()


def release() -> None:
    """Give memory that Arrow and numpy have freed back to the machine: Python workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def lean_batches(work: Callable):
    """A function of an iterator of batches that leaves no freed memory behind."""

    def run(batches):
        yield from work(batches)
        release()

    return run


def lean(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of one or two Arrow tables that leaves no freed memory behind."""
    if work.__code__.co_argcount == 1:

        def one(table):
            out = work(table)
            release()
            return out

        return one

    def two(left, right):
        out = work(left, right)
        release()
        return out

    return two


def partitions(spark: SparkSession) -> int:
    """Blocks and buckets follow spark.sql.shuffle.partitions, which is sized to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
