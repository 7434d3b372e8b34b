"""Arrow functions that are built when they are called, so that modules import without a session, on workers too."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Bytes of a batch that are Python objects at once: a batch may hold 10,000 whole pages.
SLICE = 4 << 20


def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: freed memory is its own affair
        return lambda _: 0


def in_slices(f):
    """f over slices of bounded size, row by row the same; freed memory goes back to the machine, as workers are used again."""

    @functools.wraps(f)
    def run(*columns):
        n = len(columns[0])
        step = max(1, n * SLICE // max(1, sum(c.nbytes for c in columns)))
        out = f(*columns) if step >= n else pa.concat_arrays([f(*[c.slice(i, step) for c in columns]) for i in range(0, n, step)])
        if step < n:
            pa.default_memory_pool().release_unused()
            _trimmer()(0)
        return out

    return run


def arrow(return_type: str):
    """Turns a function of Arrow arrays into one of Columns."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns: Column) -> Column:
            return F.arrow_udf(in_slices(f), return_type)(*columns)

        return call

    return wrap
