"""Synthetic graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.draws import draw


def rmat(spark: SparkSession, scale: int, n_edges: int, a: float, b: float, c: float, d: float, seed: int = 1) -> DataFrame:
    """n_edges edges over 2^scale vertices: each edge falls through ``scale`` levels of quadrants.

    The quadrants are a: low column and row, b: high column, c: high row,
    d: both high; the column is the source, the row the end.
    """
    if abs(a + b + c + d - 1) > 0.01:
        raise ValueError("the four probabilities must sum to 1")
    src = dst = F.lit(0).cast("long")
    for level in range(scale):
        u = draw(seed, F.col("id"), level)
        high_col = ((u >= a) & (u < a + b)) | (u >= a + b + c)
        high_row = u >= a + b
        bit = F.lit(1 << (scale - 1 - level)).cast("long")
        src = src + F.when(high_col, bit).otherwise(F.lit(0))
        dst = dst + F.when(high_row, bit).otherwise(F.lit(0))
    return spark.range(n_edges).select(src.alias("src"), dst.alias("dst"))


def rmat_any(spark: SparkSession, vertices: int, n_edges: int, a: float, b: float, c: float, d: float, seed: int = 1) -> DataFrame:
    """As rmat, over any number of vertices: a range of ids is halved, its low half being the longer, until one id is left.

    With 2^scale vertices the edges are those of rmat.
    """
    if abs(a + b + c + d - 1) > 0.01:
        raise ValueError("the four probabilities must sum to 1")
    if vertices < 1:
        raise ValueError("there must be a vertex")

    def half(low, size, high):
        rest = F.floor(size / 2)
        return F.when(high & (size > 1), low + size - rest).otherwise(low), F.when(size <= 1, size).when(high, rest).otherwise(size - rest)

    def fall(at, level):
        u = draw(seed, F.col("id"), level)
        src, src_size = half(at["src"], at["src_size"], ((u >= a) & (u < a + b)) | (u >= a + b + c))
        dst, dst_size = half(at["dst"], at["dst_size"], u >= a + b)
        return F.struct(src.alias("src"), src_size.alias("src_size"), dst.alias("dst"), dst_size.alias("dst_size"))

    zero, all_ = F.lit(0).cast("long"), F.lit(vertices).cast("long")
    start = F.struct(zero.alias("src"), all_.alias("src_size"), zero.alias("dst"), all_.alias("dst_size"))
    levels = F.array(*map(F.lit, range((vertices - 1).bit_length()))) if vertices > 1 else F.array().cast("array<int>")
    at = F.aggregate(levels, start, fall)
    return spark.range(n_edges).select(at.alias("at")).select("at.src", "at.dst")
