"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; the number of rounds grows with the
logarithm of the number of vertices, not with the diameter. The state is a
table of edges that shrinks to one star a component, written to shared storage
after each round. The edges at a star's centre are spread over several parts
where there are more of them than a task should hold. Only a count and a
checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans import dealt
from graphloom.plans.scratch import Scratch


def _mark(e: DataFrame):
    return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def _with_least(e: DataFrame, key: str, least: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """e joined with least(key, m). A table of no more rows than a task may hold has no key to be split."""
    if n <= dealt.HUB:
        return e.join(least, key)
    rows = dealt.Dealt(e, key, scratch)
    out = scratch.save(rows.join(least))
    rows.close()
    return out


def star_components(pairs: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """(id, component) of every id of pairs(u, v) but the least of each component, which is its component.

    The two ends of a pair have one orderable type. Pairs with a null end or
    equal ends say nothing.
    """
    e = pairs.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    e = scratch.save(e)
    before = _mark(e)
    for _ in range(max_rounds if before[0] else 0):
        # large star: the greater ends of a vertex's edges go to the least vertex around it, or to itself
        both = e.select(F.col("b").alias("c"), F.col("a").alias("o")).union(e.select("a", "b"))
        least = both.groupBy("c").agg(F.min("o").alias("o")).select(F.col("c").alias("b"), F.least("o", "c").alias("m"))
        large = scratch.save(_with_least(e, "b", least, before[0], scratch).select("a", F.col("m").alias("b")).distinct())
        # small star: the lesser ends of a vertex's edges, and itself, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, "a", low, before[0], scratch).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        new = scratch.save(small.distinct())
        scratch.drop(large, e)
        e, after = new, _mark(new)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
