"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, *cols: Column) -> DataFrame:
    """The chosen columns and ``row``, a number that tells repeated rows apart.

    It follows the place of a row in its scan, so it is the same whenever the
    files are read again; other inputs should be checkpointed first.  How files
    are split depends on the cores there are, unless it is set: it is pinned
    here, as executors may come and go between two readings.
    """
    pin = "spark.sql.files.minPartitionNum"
    spark = df.sparkSession
    if spark.conf.get(pin, None) is None:
        spark.conf.set(pin, str(spark.sparkContext.defaultParallelism))
    return df.select(F.monotonically_increasing_id().alias("row"), *cols)


def lean(run: Callable) -> Callable:
    """``run`` over the batches of a task, which hands freed memory back to the system at its end.

    Python workers outlive their tasks; without this each keeps what its
    largest batch took while later stages run beside it.
    """
    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
            if trim:
                trim(0)
    return task


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def large(texts: pa.Array) -> pa.Array:
    """A copy as large_string without nulls; text functions go wrong on some slices."""
    return pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "").cast(pa.large_string())


def chunks(texts: pa.Array, size: int) -> Iterator[slice]:
    """Runs of texts of up to ``size`` bytes; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        low = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, low + size, "right")))
        yield slice(first, last)
        first = last
