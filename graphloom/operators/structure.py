"""Structure: connected components and k-core."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.graph import Graph
from graphloom.operators.components import star_components
from graphloom.plans.dealt import Dealt
from graphloom.plans.scratch import Scratch


def connected_components(graph: Graph, scratch: Scratch) -> DataFrame:
    """(id, component): the least id of each weakly connected component, to the fixpoint."""
    found = star_components(graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), scratch)
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def propagate_labels(graph: Graph, scratch: Scratch, iterations: int = 5, symmetric: bool = False) -> DataFrame:
    """(id, component) after so many rounds of taking the least label around: may stop before the fixpoint.

    symmetric says that edges go both ways already. Labels are ids at first, so
    the first round needs no messages; later only labels that fell are sent, as
    the others have arrived.
    """
    if not iterations:
        return graph.vertices.select("id", F.col("id").alias("component"))
    both = Dealt(graph.edges.select("src", "dst") if symmetric else graph.undirected().edges.select("src", "dst"), "src", scratch)
    first = both.rows.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("low")).select("id", F.least("id", "low").alias("component"))
    if graph._given is not None:
        first = first.union(graph._given.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
    labels = scratch.save(first.withColumn("fell", F.col("component") < F.col("id")))
    for _ in range(iterations - 1):
        sent = labels.filter("fell").select(F.col("id").alias("src"), "component")
        near = both.join(sent).groupBy("dst").agg(F.min("component").alias("low"))
        got = labels.join(near, labels["id"] == near["dst"], "left")
        after = scratch.save(got.select("id", F.least("component", "low").alias("component"), F.coalesce(F.col("low") < F.col("component"), F.lit(False)).alias("fell")))
        scratch.drop(labels)
        labels = after
    both.close()
    return labels.drop("fell")


def _h_index(far: DataFrame) -> DataFrame:
    """(id, h) of far(src, far): the h-index of the estimates around each vertex.

    It comes from counts by estimate, so edges are combined before the shuffle
    and a hub's window holds one row a distinct estimate and not one a neighbour.
    """
    down = W.partitionBy("id").orderBy(F.col("far").desc()).rowsBetween(W.unboundedPreceding, 0)
    counts = far.groupBy(F.col("src").alias("id"), "far").agg(F.count("*").alias("n"))
    # of the neighbours with estimate k or more there are `have`: min(k, have) is a lower bound of h, and the best one is h
    return counts.withColumn("have", F.sum("n").over(down)).groupBy("id").agg(F.max(F.least("far", "have")).alias("h"))


def kcore(graph: Graph, scratch: Scratch, max_sweeps: int = 1000, every: int = 4, max_active: float = 0.05) -> DataFrame:
    """(id, core) of a symmetric graph: estimates fall from the degree to the h-index of the neighbours' estimates.

    Estimates only fall, so a sweep needs no look at the old ones: it sends them
    to the edges, which are dealt by the far end and stay where they are. The
    lineage is cut ``every`` sweeps. Once fewer than max_active of the estimates
    fell between two cuts, only the vertices around those are looked at again.
    """
    edges = scratch.save(graph.edges.select("src", "dst"))
    by_far, by_near = Dealt(edges, "dst", scratch), None
    est = scratch.save(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("est")))
    total = est.count()
    sent = lambda e: e.select(F.col("id").alias("dst"), F.col("est").alias("far"))
    fell, done = None, 0
    while done < max_sweeps:
        new = est
        if fell is None:
            for _ in range(min(every, max_sweeps - done)):
                new, done = _h_index(by_far.join(sent(new)).select("src", "far")).select("id", F.col("h").alias("est")), done + 1
        else:
            by_near = by_near or Dealt(edges, "src", scratch)
            around = by_far.join(fell.select(F.col("id").alias("dst"))).select("src").distinct()
            h = _h_index(by_near.join(around).join(sent(est), "dst").select("src", "far"))
            new, done = est.join(h, "id", "left").select("id", F.coalesce("h", "est").alias("est")), done + 1
        new = scratch.save(new)
        less = scratch.save(new.join(est.withColumnRenamed("est", "old"), "id").filter("est < old").select("id"))
        n = less.count()
        scratch.drop(est, fell)
        est, fell = new, less if n <= max_active * total else None
        if not n:
            break
    by_far.close()
    if by_near:
        by_near.close()
    return est.select("id", F.col("est").alias("core"))
