"""Vertex programs: init, message, merge, apply and halt as Column builders.

Each superstep is one plan: active vertices send along their out-edges,
messages are merged by their receivers, and every vertex with a message
applies it. A vertex is active until it votes to halt and is woken by a
message; the program ends when nothing is active.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.dealt import Dealt
from graphloom.plans.scratch import Scratch


@dataclass
class Program:
    """init: state columns over ``id`` (and value columns of the vertices). message: over the sender's state
    and the edge, null to send nothing. merge: an aggregate of a message column. apply: from the merged Column
    to new state columns. halt: over the new state, after apply; init_active: who sends at first.
    """

    init: dict[str, Column]
    message: Column
    merge: Callable[[Column], Column]
    apply: Callable[[Column], dict[str, Column]]
    halt: Column
    init_active: Column | None = None


def run(graph: Graph, program: Program, scratch: Scratch, max_steps: int = 100) -> DataFrame:
    """(id, state columns) once nothing is active, or after max_steps; one count a step reaches the driver."""
    edges = Dealt(scratch.save(graph.edges), "src", scratch)
    names = list(program.init)
    on = F.lit(True) if program.init_active is None else program.init_active
    state = graph.vertices.select("id", *[c.alias(n) for n, c in program.init.items()])
    state = scratch.save(state.withColumn("_on", F.coalesce(on, F.lit(False))))
    for _ in range(max_steps):
        sent = edges.join(state.filter("_on").drop("_on").withColumnRenamed("id", "src")).select(F.col("dst").alias("id"), program.message.alias("_m"))
        got = scratch.save(sent.filter("_m is not null").groupBy("id").agg(program.merge(F.col("_m")).alias("_m")))
        if not got.take(1):
            break
        both = state.drop("_on").join(got, "id", "left")
        new = program.apply(F.col("_m"))
        both = both.select("id", "_m", *[F.col(n).alias(f"_old_{n}") for n in names], *[F.when(F.col("_m").isNotNull(), new[n]).otherwise(F.col(n)).alias(n) if n in new else F.col(n) for n in names])
        changed = ~F.struct(*names).eqNullSafe(F.struct(*[F.col(f"_old_{n}").alias(n) for n in names]))
        active = F.col("_m").isNotNull() & ~F.coalesce(program.halt, F.lit(False)) & changed
        after = scratch.save(both.select("id", *names, active.alias("_on")))
        scratch.drop(state, got)
        state = after
    edges.close()
    return state.drop("_on")


def hops_from(graph: Graph, source: Column, scratch: Scratch, max_steps: int = 100) -> DataFrame:
    """(id, hops): the least number of hops from any vertex for which source holds; null where there is no way."""
    far = Program(
        init={"hops": F.when(source, F.lit(0).cast("long"))}, message=F.col("hops") + 1, merge=F.min, halt=F.lit(False),
        apply=lambda m: {"hops": F.least("hops", m)}, init_active=F.coalesce(source, F.lit(False)),
    )
    return run(graph, far, scratch, max_steps)
