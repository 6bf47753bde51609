"""Size of the Arrow batches that Python steps get, and sums inside a task."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of partial sums that a task holds at most, about.
HELD_ROWS = 1 << 20
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Jobs run inside hand at most `rows` rows to Python at a time: rows with texts or sets are kilobytes wide."""
    before = spark.conf.get(_KEY)
    spark.conf.set(_KEY, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_KEY, before)


@contextmanager
def released_shuffles(spark: SparkSession):
    """Shuffle files of jobs run inside go when the job ends, as a written table has what they led to.

    Within a job they stay, for tasks that are run again. A query that is run
    twice shuffles twice.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def summed_in_task(tables: Iterator[pa.Table], keys: list[str], sums: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of `tables` with equal keys added up, as far as `HELD_ROWS` of them are held together."""

    def summed(held):
        out = pa.concat_tables(held).group_by(keys).aggregate([(c, "sum") for c in sums])
        return out.select([*keys, *[f"{c}_sum" for c in sums]]).rename_columns([*keys, *sums])

    held, n, base = [], 0, 0
    for table in tables:
        held.append(table)
        n += table.num_rows
        if n >= 2 * base + HELD_ROWS // 8:
            held = [summed(held)]
            n = base = held[0].num_rows
        if base >= HELD_ROWS:
            yield from held[0].to_batches()
            held, n, base = [], 0, 0
    if held:
        yield from summed(held).to_batches()


def pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: pa.DataType = pa.string()) -> pa.Array:
    """The stretches start..end of bytes, UTF-8 if they are to be strings."""
    lengths = end - start
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    take = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], lengths)
    large = pa.large_binary() if pa.types.is_binary(kind) else pa.large_string()
    return pa.Array.from_buffers(large, len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[take])]).cast(kind)
