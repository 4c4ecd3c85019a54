"""Vertex programs: gather over incident edges, apply to the vertex, scatter by state.

A program is a set of Column builders, so every step is one Catalyst plan: a
join of edges with the state of their far ends, a grouped aggregate, and a
join with the state of the vertices. State replaces edge values: what a vertex
would scatter is a column that its neighbours gather.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.dealt import Dealt
from graphloom.plans.iterate import iterate
from graphloom.plans.scratch import Scratch


@dataclass
class Gather:
    """One gather-apply step.

    direction: "in" gathers from sources of in-edges, "out" from ends of
    out-edges, "all" from both, "none" from nothing. gather: an aggregate over
    columns of the neighbour's state and of the edge; a fold of one's own is a
    grouped-aggregate Pandas UDF, which holds a vertex's neighbours in one
    task. init: its value for vertices without any. apply: from the gathered Column to new state columns.
    """

    direction: str
    gather: Column
    init: Column
    apply: Callable[[Column], dict[str, Column]]
    where: Column | None = None


def incident(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (me, far, ...) in the direction of gathering."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    into = edges.select(F.col("dst").alias("me"), F.col("src").alias("far"), *rest)
    out = edges.select(F.col("src").alias("me"), F.col("dst").alias("far"), *rest)
    return {"in": into, "out": out, "all": into.unionByName(out), "none": into.limit(0)}[direction]


def gas(edges: DataFrame, state: DataFrame, program: Gather, scratch: Scratch, times: int, activate: str = "all", max_active: float = 0.2) -> DataFrame:
    """state(id, ...) after ``times`` steps of the program.

    activate "all": every vertex runs each time. "changed": after the first
    step only vertices that gather from one whose state changed run, and the
    loop ends when nothing changed; "changed_out" and "changed_in" schedule the
    out- and in-neighbours of what changed instead. Vertices gather from all
    their neighbours in any case.
    program.where leaves vertices out of the update.
    """
    columns = state.columns
    dealt = Dealt(incident(edges, program.direction), "far", scratch)
    near = incident(edges, {"changed_out": "in", "changed_in": "out"}[activate]) if activate in ("changed_out", "changed_in") else dealt.rows.drop("_salt")

    def run(s: DataFrame, only: DataFrame | None) -> DataFrame:
        far = s.select(F.col("id").alias("far"), *[c for c in columns if c != "id"])
        rows = dealt.join(far)
        if only is not None:
            rows = rows.join(only.select(F.col("id").alias("me")), "me", "left_semi")
        got = rows.groupBy(F.col("me").alias("id")).agg(program.gather.alias("_g"))
        both = s.join(got, "id", "left").withColumn("_g", F.coalesce("_g", program.init))
        new = program.apply(F.col("_g"))
        runs = F.lit(True) if program.where is None else program.where
        if only is not None:
            both = both.join(only.select("id", F.lit(True).alias("_on")), "id", "left")
            runs = runs & F.coalesce("_on", F.lit(False))
        return both.select(*[F.when(runs, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns])

    if activate == "all":
        out = iterate(state, lambda s, _: run(s, None), scratch, times)
        dealt.close()
        return out
    state = scratch.save(state)
    total, frontier = state.count(), None
    for _ in range(times):
        new = scratch.save(run(state, frontier))
        values = [c for c in columns if c != "id"]
        old = state.select("id", F.struct(*values).alias("_old"))
        changed = scratch.save(new.join(old, "id").filter(~F.struct(*values).eqNullSafe(F.col("_old"))).select("id"))
        scratch.drop(state)
        state, n = new, changed.count()
        if not n:
            break
        # a large frontier costs more to look up than it saves
        frontier = None if n > max_active * total else scratch.save(near.join(changed.select(F.col("id").alias("far")), "far", "left_semi").select(F.col("me").alias("id")).distinct())
    dealt.close()
    return state


def multi_compute_rows(edges: DataFrame, matrix: DataFrame, gather: Callable[[Column], Column], apply: Callable[[Column, Column], Column], scratch: Scratch, times: int, columns: list[str], direction: str = "in", init: float = 0.0) -> DataFrame:
    """K computations kept as columns of matrix(id, columns...): gather and apply are built for each column, apply from the gathered and the old value."""
    state = dict.fromkeys(columns)
    dealt = Dealt(incident(edges, direction), "far", scratch)

    def step(s: DataFrame, _: int) -> DataFrame:
        rows = dealt.join(s.select(F.col("id").alias("far"), *state))
        got = rows.groupBy(F.col("me").alias("id")).agg(*[gather(F.col(c)).alias(f"_g_{c}") for c in state])
        return s.join(got, "id", "left").select("id", *[apply(F.coalesce(f"_g_{c}", F.lit(init)), F.col(c)).alias(c) for c in state])

    out = iterate(matrix.select("id", *state), step, scratch, times)
    dealt.close()
    return out


def multi_compute(edges: DataFrame, state: DataFrame, gather: Column, apply: Callable[[Column], Column], scratch: Scratch, times: int, direction: str = "in", init: float = 0.0, where: Column | None = None) -> DataFrame:
    """K computations in one pass: state(id, comp, value), gathered by (vertex, computation)."""
    dealt = Dealt(incident(edges, direction), "far", scratch)

    def step(s: DataFrame, _: int) -> DataFrame:
        got = dealt.join(s.select(F.col("id").alias("far"), "comp", "value")).groupBy(F.col("me").alias("id"), "comp").agg(gather.alias("_g"))
        both = s.join(got, ["id", "comp"], "left").withColumn("_g", F.coalesce("_g", F.lit(init)))
        new = apply(F.col("_g"))
        return both.select("id", "comp", (new if where is None else F.when(where, new).otherwise(F.col("value"))).alias("value"))

    out = iterate(state, step, scratch, times)
    dealt.close()
    return out
