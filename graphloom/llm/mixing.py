"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r, how often the mix takes it. Rates stay as close
to 1 as Kullback-Leibler divergence allows while each source's taken words meet
its target and no rate exceeds CAP. The solution is an exponential tilt by
document size, r = min(CAP, exp(lambda * size / scale)), with one multiplier
for each source; Newton steps on the logarithm of the taken words, kept inside
a bracket, find it. Each step is one grouped sum over the histogram of
(source, size), which pre-aggregates the corpus exactly, joined with the state
table of the sources; nothing but the largest error reaches the driver.

Rates become whole copies: for each source the sizes are walked from the
largest down and each size's number of copies takes up the words that rounding
has left so far. Within a size, documents get their copies in the order of a
hash of their id and text, ranked in parts of the whole mix whose number grows
with the table, one for each PART rows, so that no task holds a large group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.common import WORD
from graphloom.plans.scratch import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix as a share of all words; most that a document or source is taken.
SHARE, CAP = 1.5, 2.0
PART, SALTS, STEPS, TOLERANCE = 100_000, 64, 60, 1e-7


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources(key, source, source_size) with ``target`` in words.

    Weights go by code point order of source, null last, and repeat. Targets
    share ``share`` of all words by weight; none exceeds ``cap`` times its
    source, the excess goes to the others by weight. The windows run over one
    row a source.
    """
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))))
    df = sources.select("*", w.alias("w"), (cap * F.col("source_size")).alias("most"))
    everything = W.partitionBy()
    before = W.orderBy(F.col("most") / F.col("w"), "key").rowsBetween(W.unboundedPreceding, -1)
    budget = share * F.sum("source_size").over(everything)
    left_words = budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    df = df.select("*", budget.alias("budget"), (F.col("most") * left_weight <= F.col("w") * left_words).alias("full"))
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything)
    heavy = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.try_divide(F.col("w") * rest, heavy))
    return df.select("key", "source_size", F.least(target, F.col("most")).alias("target"), "most")


def rate(lam: Column, size: Column, scale: Column, cap: float = CAP) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(lam * size / scale, F.lit(50.0))))


def solve(hist: DataFrame, goal: DataFrame, scratch: Scratch, cap: float = CAP) -> DataFrame:
    """goal with (lam, scale): the multiplier of each source. hist(key, size, c), goal(key, source_size, target, most)."""
    scale = hist.filter("size > 0").groupBy("key").agg((F.sum(F.col("c") * F.col("size") * F.col("size")) / F.sum(F.col("c") * F.col("size"))).alias("scale"))
    ratio = F.try_divide(F.col("target"), F.col("source_size"))
    state = goal.join(scale, "key").select(
        "key", "source_size", "target", "most", "scale", F.lit(0.0).alias("lam"),
        (F.col("scale") * F.log(F.least(F.lit(1.0), ratio)) - 1e-9).alias("lo"), (F.col("scale") * F.log(F.lit(cap)) + 1e-9).alias("hi"),
        (F.col("target") >= F.col("most") * (1 - 1e-12)).alias("done"),
    )
    state = scratch.save(state.withColumn("error", F.when(F.col("done"), 0.0).otherwise(1.0)))
    for _ in range(STEPS):
        if not state.filter("not done").take(1):
            break
        r = rate(F.col("lam"), F.col("size"), F.col("scale"), cap)
        words = F.col("c") * F.col("size") * r
        sums = hist.filter("size > 0").join(state.filter("not done").select("key", "lam", "scale"), "key").groupBy("key").agg(F.sum(words).alias("f"), F.sum(F.when(r < cap, words * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"))
        s = state.join(sums, "key", "left")
        gap = F.log(F.col("target")) - F.log(F.col("f"))
        s = s.withColumn("ok", F.col("done") | (F.abs(F.col("f") - F.col("target")) <= F.greatest(F.lit(0.01), TOLERANCE * F.col("target"))) | (F.col("hi") - F.col("lo") < 1e-12 * F.greatest(F.lit(1.0), F.abs("hi"))))
        s = s.withColumn("lo2", F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))).withColumn("hi2", F.when(F.col("f") > F.col("target"), F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") + F.try_divide(gap * F.col("f"), F.col("slope"))
        inside = (newton > F.col("lo2")) & (newton < F.col("hi2"))
        step = F.when(F.col("ok"), F.col("lam")).when(inside, newton).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        new = s.select("key", "source_size", "target", "most", "scale", step.alias("lam"), F.when(F.col("ok"), F.col("lo")).otherwise(F.col("lo2")).alias("lo"), F.when(F.col("ok"), F.col("hi")).otherwise(F.col("hi2")).alias("hi"), F.col("ok").alias("done"), F.abs(F.coalesce(gap, F.lit(0.0))).alias("error"))
        old, state = state, scratch.save(new)
        scratch.drop(old)
    return state


def _round(cap: float):
    def whole(cells: pa.Table) -> pa.Table:
        """(key, size, c, rate) of a source, one row a distinct size, to its numbers of copies."""
        size, c, r = (np.asarray(cells.column(x)) for x in ("size", "c", "rate"))
        copies = np.zeros(len(size), np.int64)
        owed = 0.0
        for i in np.argsort(-size, kind="stable").tolist():
            n, exact = int(size[i]), float(c[i] * r[i])
            copies[i] = c[i] if n == 0 else min(int(cap * c[i]), max(0, round(exact + owed / n)))
            owed += (exact - copies[i]) * n
        return pa.table({"key": cells.column("key"), "size": cells.column("size"), "c": cells.column("c"), "rate": cells.column("rate"), "k": pa.array(copies)})

    return whole


def mix(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Rows (id, keep..., size, source_size, target, rate, copies, taken) for every row of docs.

    Null texts have size 0; documents of size 0 are taken once. A null source
    is a source of its own, null ids are told apart by their texts. Repeated rows
    may get different numbers of copies; which of them is left open, all else
    agrees between runs. Other columns of docs are ignored; an empty table gives
    none.
    """
    own = docs.select(F.col(id_col).alias("_id"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)], F.col(source_col).cast("string").alias("_src"), source_key(F.col(source_col)).alias("key"), size_of(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col).alias("hash"))
    salts = max(SALTS, -(-docs.count() // PART))
    own = own.withColumn("salt", F.pmod(F.xxhash64("hash", F.lit("mix")), F.lit(salts)))
    parts = scratch.save(own.groupBy("key", "size", "salt").agg(F.min("_src").alias("source"), F.count("*").alias("c")))
    hist = scratch.save(parts.groupBy("key", "size").agg(F.min("source").alias("source"), F.sum("c").alias("c")))
    goal = targets(hist.groupBy("key").agg(F.min("source").alias("source"), F.sum(F.col("c") * F.col("size")).alias("source_size")), weights, share, cap)
    goal = scratch.save(goal)
    state = solve(hist, goal, scratch, cap)
    tilt = F.when(F.col("lam").isNull(), F.lit(1.0)).when(F.col("target") >= F.col("most") * (1 - 1e-12), F.lit(cap)).otherwise(rate(F.col("lam"), F.col("size"), F.col("scale"), cap))
    cells = hist.join(state.select("key", "lam", "scale", "target", "most"), "key", "left").select("key", "size", "c", tilt.alias("rate"))
    cells = cells.groupBy("key").applyInArrow(_round(cap), "key string, size long, c long, rate double, k long")
    before = F.coalesce(F.sum("c").over(W.partitionBy("key", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = parts.select("key", "size", "salt", before.alias("before")).join(cells.select("key", "size", F.col("c").alias("n"), "rate", "k"), ["key", "size"])
    plan = scratch.save(plan.join(goal.select("key", "source_size", "target"), "key"))
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("key", "size", "salt").orderBy("hash", "_id")))
    got = ranked.join(plan, ["key", "size", "salt"])
    copies = F.floor(F.col("k") / F.col("n")) + (F.col("before") + F.col("rank") <= F.pmod(F.col("k"), F.col("n"))).cast("long")
    got = got.withColumn("copies", copies)
    return got.select(F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], "size", "source_size", F.col("target").cast("double").alias("target"), "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
