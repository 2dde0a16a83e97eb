"""Vectors as integers in bounded blocks: shared by the exact search and the vector codes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A block holds at most this many components (and one row at least).
BLOCK_CELLS = 1 << 20
#: Bytes of one Arrow batch where rows are whole blocks.
BATCH_BYTES = 32 << 20


def usable(vec: Column) -> Column:
    """Whether a vector is given and all its components are finite numbers."""
    x = vec.cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & ~bad, F.lit(False))


def floors(column: pa.Array, scale: int, limit: int) -> np.ndarray:
    """``floor(scale * x)`` of every component of a list column, flat; beyond ``limit`` it is an error."""
    x = np.floor(np.asarray(column.flatten(), np.float64) * scale)
    if len(x) and not np.abs(x).max() <= limit:
        raise ValueError(f"a vector component is beyond {limit / scale:g}: its integer arithmetic would overflow")
    return x.astype(np.int64)


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Rows over at least two tasks a core; larger inputs keep the partitions of their files."""
    n = most or 2 * parallelism(rows.sparkSession)
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(n)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Bounds the bytes of Arrow batches while a stage over block rows runs; the session's value comes back after it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, dealt into batches of exactly ``rows`` rows (the last may be shorter)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, rows - n)
            held.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
