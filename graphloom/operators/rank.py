"""Ranking: PageRank and its relatives, each sweep one join and one aggregation.

Edges carry their share of the source's value, are dealt by source once and
kept, so a sweep moves the rank table and the partial sums only. Sweeps are
synchronous: a sweep reads the values of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.gas import Gather, gas
from graphloom.plans.dealt import Dealt
from graphloom.plans.iterate import iterate
from graphloom.plans.scratch import Scratch

RESET, DAMPING = 0.15, 0.85
#: Vertices of a side, an id and a number each, that may be sent to every task.
FEW = 500_000


def stored(graph: Graph, scratch: Scratch, *columns: str) -> Graph:
    """The graph with its edges written once: degrees, vertices and shares then read them instead of making them again."""
    return Graph(scratch.save(graph.edges.select("src", "dst", *columns)), graph._given)


def pagerank(graph: Graph, scratch: Scratch, sweeps: int = 3, weight: str | None = None) -> DataFrame:
    """(id, rank): rank 1 at first, then RESET + DAMPING * (sum of in-neighbours' shares), not normalised.

    With weight, an edge carries weight / (its source's sum of weights);
    weights may not be null.
    """
    if not sweeps:
        return graph.vertices.select("id", F.lit(1.0).alias("rank"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = Dealt(graph.edges.select("src", "dst", *([w.alias("w")] if weight else [])), "src", scratch)
    w = F.col("w") if weight else F.lit(1.0)
    out = e.rows.groupBy("src").agg(F.sum(w).alias("out"))

    def sent(r: DataFrame) -> DataFrame:
        return e.join(r.filter("out is not null").select("src", (F.col("rank") / F.col("out")).alias("x"))).groupBy("dst").agg(F.sum(F.col("x") * w).alias("got"))

    new = (RESET + DAMPING * F.coalesce("got", F.lit(0.0))).alias("rank")
    # the first sweep reaches every vertex with in-edges, so it gives the ids too
    first = out.join(sent(out.withColumn("rank", F.lit(1.0))), F.col("src") == F.col("dst"), "full").select(F.coalesce("src", "dst").alias("src"), "out", "got")
    if graph._given is not None:
        first = first.join(graph._given.select(F.col("id").alias("src")).distinct(), "src", "full")
    state = scratch.save(first.select("src", "out", new))

    def sweep(r: DataFrame, _: int) -> DataFrame:
        return r.join(sent(r), F.col("src") == F.col("dst"), "left").select("src", "out", new)

    last = iterate(state, sweep, scratch, sweeps - 1, every=1)
    e.close()
    return last.select(F.col("src").alias("id"), "rank")


def gas_pagerank(graph: Graph, scratch: Scratch, sweeps: int = 3) -> DataFrame:
    """The same by gather, apply and scatter."""
    graph = stored(graph, scratch)
    out = graph.degrees().select("id", "out_degree")
    state = out.select("id", F.lit(1.0).alias("rank"), F.try_divide(F.lit(1.0), F.col("out_degree")).alias("sent"), "out_degree")
    program = Gather(
        direction="in", gather=F.sum("sent"), init=F.lit(0.0),
        apply=lambda g: {"rank": RESET + DAMPING * g, "sent": F.try_divide(RESET + DAMPING * g, F.col("out_degree"))},
    )
    return gas(graph.edges, state, program, scratch, sweeps).select("id", "rank")


def topic_pagerank(graph: Graph, seeds: DataFrame, scratch: Scratch, sweeps: int = 3) -> DataFrame:
    """(id, topic, score): personalised to seeds(id, topic), all topics in one pass.

    Vertices with out-edges hold y = (RESET * seed + DAMPING * sum of y of
    in-neighbours) / out-degree; the others keep RESET on their seeds. The
    result is multiplied by the out-degree again.
    """
    graph = stored(graph, scratch)
    e = Dealt(graph.edges, "src", scratch)
    out = scratch.save(graph.degrees().filter("out_degree > 0").select("id", "out_degree"))
    seed = scratch.save(seeds.select("id", "topic").distinct())
    own = seed.join(out, "id").select("id", "topic", (F.lit(RESET) / F.col("out_degree")).alias("base"))
    fixed = scratch.save(seed.join(out, "id", "left_anti").select("id", "topic", F.lit(RESET).alias("y")))

    def sweep(y: DataFrame, _: int) -> DataFrame:
        y = y.union(fixed)
        got = e.join(y.withColumnRenamed("id", "src")).groupBy(F.col("dst").alias("id"), "topic").agg(F.sum("y").alias("got"))
        got = got.join(out, "id").select("id", "topic", (DAMPING * F.col("got") / F.col("out_degree")).alias("y"))
        return got.union(own.select("id", "topic", "base")).groupBy("id", "topic").agg(F.sum("y").alias("y"))

    first = seed.join(out.select("id"), "id", "left_semi").select("id", "topic", F.lit(RESET).alias("y"))
    last = iterate(first, sweep, scratch, sweeps)
    e.close()
    return last.join(out, "id").select("id", "topic", (F.col("y") * F.col("out_degree")).alias("score")).union(fixed)


def topic_weights(rows: DataFrame, cutoff: float = 0.0, square: bool = False) -> DataFrame:
    """(id, topic, weight): repeated rows add up (squared first if asked), sums under the cutoff become 0."""
    w = F.col("weight") * F.col("weight") if square else F.col("weight")
    total = rows.groupBy("id", "topic").agg(F.sum(w).alias("weight"))
    return total.withColumn("weight", F.when(F.col("weight") < cutoff, F.lit(0.0)).otherwise(F.col("weight")))


def weighted_topic_pagerank(graph: Graph, weights: DataFrame, scratch: Scratch, sweeps: int = 3) -> DataFrame:
    """(id, topic, score) from weights(id, topic, weight), zero where missing.

    y = (RESET * w + DAMPING * w * sum of y of in-neighbours) / (sum of w over
    out-neighbours), undivided where that sum is 0; divided values are
    multiplied back at the end. Only vertices with out-edges are updated.
    """
    graph = stored(graph, scratch)
    e = Dealt(graph.edges, "src", scratch)
    w = scratch.save(weights.filter("weight <> 0"))
    live = scratch.save(graph.edges.select(F.col("src").alias("id")).distinct())
    out = graph.edges.join(w, graph.edges["dst"] == w["id"]).groupBy(F.col("src").alias("id"), "topic").agg(F.sum("weight").alias("out"))
    own = scratch.save(w.join(live, "id", "left_semi").join(out, ["id", "topic"], "left").select("id", "topic", "weight", F.when(F.col("out") != 0, F.col("out")).otherwise(F.lit(1.0)).alias("out")))
    rest = scratch.save(w.join(live, "id", "left_anti").select("id", "topic", (RESET * F.col("weight")).alias("y")))

    def sweep(y: DataFrame, _: int) -> DataFrame:
        y = y.union(rest)
        got = e.join(y.withColumnRenamed("id", "src")).groupBy(F.col("dst").alias("id"), "topic").agg(F.sum("y").alias("got"))
        return own.join(got, ["id", "topic"], "left").select("id", "topic", (F.col("weight") * (RESET + DAMPING * F.coalesce("got", F.lit(0.0))) / F.col("out")).alias("y"))

    last = iterate(own.select("id", "topic", (RESET * F.col("weight")).alias("y")), sweep, scratch, sweeps)
    e.close()
    return last.join(own, ["id", "topic"]).select("id", "topic", (F.col("y") * F.col("out")).alias("score")).union(rest)


class _Sides:
    """Edges of a bipartite graph dealt by their right end and kept, with (src, out) of the left side.

    A left side of up to FEW vertices is sent to all tasks, where the edges of a
    right vertex lie together, so no sums are shuffled; a larger one is joined
    with edges dealt by the left end.
    """

    def __init__(self, edges: DataFrame, scratch: Scratch):
        self.scratch = scratch
        self.by_dst = Dealt(edges.select("src", "dst", F.col("value").cast("double").alias("value")), "dst", scratch)
        self.out = scratch.save(self.by_dst.rows.groupBy("src").agg(F.count("*").alias("out")))
        self.few = self.out.count() <= FEW
        self.by_src = None

    def to_right(self, left: DataFrame | None) -> DataFrame:
        """(dst, x) a row an edge, from left(src, x) or, without it, the values of the edges."""
        if left is None:
            return self.by_dst.rows.select("dst", F.col("value").alias("x"))
        if self.few:
            return self.by_dst.rows.join(F.broadcast(left), "src").select("dst", "x")
        self.by_src = self.by_src or Dealt(self.by_dst.rows.select("src", "dst"), "src", self.scratch)
        return self.by_src.join(left).select("dst", "x")

    def close(self) -> None:
        self.by_dst.close()
        if self.by_src:
            self.by_src.close()


def hits(edges: DataFrame, scratch: Scratch, iterations: int = 8, total: DataFrame | None = None) -> DataFrame:
    """(id, score) of the left side of a bipartite graph, by HITS: score > 0 only.

    edges(src, dst, value): left to right; the first right pass reads value.
    total(id, total) overrides the in-degree of right vertices as list length.
    Even passes update the right side, odd ones the left; two numbers (the
    norms) reach the driver. The edges are dealt once and kept, by either side if the left is large.
    """
    if iterations < 2:
        raise ValueError("the left side has no score before two passes")
    sides = _Sides(edges, scratch)
    right = sides.by_dst.rows.groupBy("dst").agg(F.count("*").alias("deg"))
    if total is not None:
        right = right.join(total.select(F.col("id").alias("dst"), "total"), "dst", "left")
        right = right.withColumn("scale", F.col("deg") / F.when(F.coalesce("total", F.lit(0)) == 0, F.col("deg")).otherwise(F.col("total")))
    else:
        right = right.withColumn("scale", F.lit(1.0))
    right = scratch.save(right.select("dst", "scale"))
    left_norm, right_norm, a, h = 1.0, 1.0, None, None
    for t in range(iterations):
        if t % 2 == 0:
            sent = sides.to_right(None if a is None else a.select("src", F.col("a").alias("x")))
            got = sent.groupBy("dst").agg(F.sum(F.col("x") / left_norm).alias("s"))
            h = scratch.save(got.join(right, "dst").select("dst", (F.col("s") * F.col("scale")).alias("h")))
            right_norm = h.agg(F.sqrt(F.sum(F.col("h") * F.col("h")))).first()[0] or 1.0
        else:
            a = scratch.save(sides.by_dst.join(h).groupBy("src").agg(F.sum(F.col("h") / right_norm).alias("a")))
            left_norm = a.agg(F.sqrt(F.sum(F.col("a") * F.col("a")))).first()[0] or 1.0
    sides.close()
    return a.select(F.col("src").alias("id"), (F.col("a") / left_norm).alias("score")).filter("score > 0")


def salsa(edges: DataFrame, scratch: Scratch, iterations: int = 8) -> DataFrame:
    """(id, score) of the left side by SALSA: values are divided by the degree of the side that sends them."""
    if iterations < 2:
        raise ValueError("the left side has no score before two passes")
    sides = _Sides(edges, scratch)
    a = h = None
    for t in range(iterations):
        if t % 2 == 0:
            sent = sides.to_right(None if a is None else a.join(sides.out, "src").select("src", (F.col("a") / F.col("out")).alias("x")))
            # the right side sends its sum over its degree
            h = scratch.save(sent.groupBy("dst").agg((F.sum("x") / F.count("*")).alias("h")))
        else:
            a = scratch.save(sides.by_dst.join(h).groupBy("src").agg(F.sum("h").alias("a")))
    sides.close()
    return a.select(F.col("src").alias("id"), F.col("a").alias("score")).filter("score > 0")
