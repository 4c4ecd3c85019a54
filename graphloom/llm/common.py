"""Shared pieces: the word rule, Arrow mappers, bounded vector sums."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text handled at once inside a Python worker.
CHUNK_BYTES = 4 << 20
BATCH_ROWS = 1000
#: Shuffle partitions that a driver can still keep track of; beyond them buckets grow.
MOST_BUCKETS = 200_000
#: Entries of one piece of a summed vector.
BLOCK = 4096


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark) -> None:
    """Whole texts go to Python workers in batches of BATCH_ROWS at most: Spark's default of 10,000 rows holds
    tens of MB of texts off the heap in each task. Plans read the setting when they run, so it stays lowered
    for the session; a smaller one of the caller's is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def size_hint(df: DataFrame) -> int:
    """Bytes that the optimiser expects of df, 0 where it doesn't know; a hint for partition counts only.

    For what it doesn't know it says 2^63 - 1, less for some of the columns: 72 PB and more count as unknown.
    """
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 56 else 0


def buckets_for(df: DataFrame, each: int, at_least: int) -> int:
    """Number of buckets of about ``each`` bytes of df."""
    return int(min(MOST_BUCKETS, max(at_least, size_hint(df) // each)))


def lean(task: Callable) -> Callable:
    """A mapper that gives freed memory back after each batch: workers are reused, and Arrow's own pool keeps what it had."""

    @functools.wraps(task)
    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        for out in task(batches):
            yield out
            del out
            _trim()
        _trim()

    return run


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def chunks(batches: Iterator[pa.RecordBatch], text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose text column holds about ``limit`` bytes at most.

    A single text longer than that makes a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def vector_pieces(vec: np.ndarray) -> pa.RecordBatch:
    """The nonzero pieces of a vector as rows (block, part)."""
    at = [b for b in range(0, len(vec), BLOCK) if vec[b : b + BLOCK].any()]
    return pa.RecordBatch.from_arrays(
        [pa.array([b // BLOCK for b in at], pa.int32()), pa.array([vec[b : b + BLOCK].tobytes() for b in at], pa.binary())],
        names=["block", "part"],
    )


PIECES = "block int, part binary"


def vector_sum(pieces: DataFrame, length: int, dtype) -> np.ndarray:
    """Sums of per-task vectors. Pieces meet by block; the driver gets ``length`` numbers, whatever the input."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = np.frombuffer(part.as_buffer(), dtype)
                if b in total:
                    total[b] += v
                else:
                    total[b] = v.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
            names=["block", "part"],
        )

    out = np.zeros(length, dtype)
    for b, part in pieces.repartition("block").mapInArrow(add, PIECES).collect():
        v = np.frombuffer(bytes(part), dtype)
        out[b * BLOCK : b * BLOCK + len(v)] += v
    return out

