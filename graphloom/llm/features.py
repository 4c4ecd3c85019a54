"""Hashed TF-IDF of character n-grams, computed whole text by whole text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.common import PIECES, vector_pieces, vector_sum

BITS = 15
DIM = 1 << BITS
_A, _B, _C, _D = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263))
_SHIFT = np.uint32(32 - BITS)


def counts(text: str) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of code points of a whole text, DIM entries."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    one = (c * _A) ^ (c >> np.uint32(7))
    found = np.bincount((one * _B) >> _SHIFT, minlength=DIM)
    if len(c) > 1:
        two = one[:-1] * _C + one[1:] * _D
        two ^= two >> np.uint32(15)
        found += np.bincount((two * _A) >> _SHIFT, minlength=DIM)
    if len(c) > 2:
        three = two[:-1] * _B + one[2:] * _A
        three ^= three >> np.uint32(13)
        found += np.bincount((three * _C) >> _SHIFT, minlength=DIM)
    return found


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, log-damped counts) of the features of a text."""
    n = counts(text)
    at = np.flatnonzero(n)
    return at, np.log1p(n[at]).astype(np.float32)


def weighted(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = tf * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def document_frequency(texts: DataFrame, lower: bool) -> tuple[np.ndarray, int]:
    """(documents with each feature, documents) over all rows of texts(text); nulls count as empty."""

    def task(batches):
        df = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                df[DIM] += 1
                if t:
                    df[:DIM] += counts(t.lower() if lower else t) > 0
        yield vector_pieces(df)

    total = vector_sum(texts.mapInArrow(task, PIECES), DIM + 1, np.int64)
    return total[:DIM], int(total[DIM])


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def smallest(rows: DataFrame, group: str, draw: Column, sizes: dict, limit: int) -> DataFrame:
    """Of each group's rows with different draws the ``limit`` with the smallest, one row a draw; sizes: about how many draws a group has.

    A first cut by the expected place of that draw leaves few more than needed,
    so what is ranked is bounded, whatever the input.
    """
    most = (1 << 63) - 1
    cuts = [(g, -most - 1 + min(2 * most + 1, int((2 * most + 1) * (1.2 * limit + 50) / max(1, n)))) for g, n in sizes.items()]
    kind = dict(rows.dtypes)[group]
    cut = rows.sparkSession.createDataFrame(cuts, f"_g {kind}, _cut long")  # one row a group
    some = rows.withColumn("_draw", draw).join(F.broadcast(cut), F.col(group) == F.col("_g")).filter("_draw <= _cut").dropDuplicates([group, "_draw"])
    place = F.row_number().over(W.partitionBy(group).orderBy("_draw"))
    return some.withColumn("_place", place).filter(F.col("_place") <= limit).select(*rows.columns)


def collect_sparse(rows: DataFrame, lower: bool, extra=lambda text: np.zeros(0, np.float32)) -> list[tuple]:
    """(label, indices, damped counts, extra(text)) of rows(label, text) in a stable order. For bounded samples only."""

    def task(batches):
        for batch in batches:
            labels = batch.column(0)
            texts = [(t or "").lower() if lower else t or "" for t in batch.column(1).to_pylist()]
            if not texts:
                continue
            at, tf = zip(*map(sparse, texts))
            yield pa.RecordBatch.from_arrays(
                [labels, pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([v.astype(np.float16).tobytes() for v in tf], pa.binary()), pa.array([extra(t).tobytes() for t in texts], pa.binary())],
                names=["label", "at", "tf", "more"],
            )

    kind = dict(rows.dtypes)[rows.columns[0]]
    got = rows.mapInArrow(task, f"label {kind}, at binary, tf binary, more binary").collect()
    out = [(r[0], np.frombuffer(bytes(r[1]), np.uint16).astype(np.int64), np.frombuffer(bytes(r[2]), np.float16).astype(np.float32), np.frombuffer(bytes(r[3]), np.float32)) for r in got]
    out.sort(key=lambda r: (str(r[0]), len(r[1]), r[1].tobytes(), r[2].tobytes()))
    return out
