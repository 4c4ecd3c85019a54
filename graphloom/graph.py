"""The graph: edges(src, dst, ...) and vertices(id, ...), both plain DataFrames.

Edges are a multigraph: duplicates stay until ``simple`` is asked for. Vertices
are the ids of the edges and those given; ``dense`` adds every id up to the
largest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Graph:
    def __init__(self, edges: DataFrame, vertices: DataFrame | None = None):
        self.edges = edges
        self._given = vertices

    @classmethod
    def from_edges(cls, raw: DataFrame, value: str | None = None, parse_value: Callable[[Column], Column] | None = None) -> Graph:
        """Edges as they come, with self-loops read as vertex values (dropped where they carry none).

        parse_value makes the vertex value of the column ``value``; where it gives null nothing is stored.
        """
        edges = raw.filter("src <> dst")
        loops = None
        if value:
            # of several loops at a vertex the greatest value holds, so that the order of rows doesn't matter
            own = parse_value(F.col(value)) if parse_value else F.col(value)
            loops = raw.filter("src = dst").select(F.col("src").alias("id"), own.alias("value")).filter("value is not null").groupBy("id").agg(F.max("value").alias("value"))
        return cls(edges, loops)

    @property
    def vertices(self) -> DataFrame:
        ids = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst"))
        if self._given is None:
            return ids.distinct()
        return ids.union(self._given.select("id")).distinct().join(self._given, "id", "left")

    def dense(self) -> DataFrame:
        """Every id from 0 to the largest, for programs that count ids without edges as vertices."""
        top = self.edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
        return self.edges.sparkSession.range(0, 0 if top is None else top + 1)

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree): one aggregation over both ends, partial sums before the shuffle."""
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        ends = self.edges.select(F.col("src").alias("id"), zero.alias("i"), one.alias("o")).union(self.edges.select("dst", one, zero))
        if self._given is not None:
            ends = ends.union(self._given.select("id", zero, zero))
        return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))

    def reverse(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), self._given)

    def undirected(self) -> Graph:
        """Each edge in both directions, duplicates kept."""
        return Graph(self.edges.unionByName(self.reverse().edges), self._given)

    def simple(self) -> Graph:
        return Graph(self.edges.select("src", "dst").distinct(), self._given)

    def symmetrize(self) -> Graph:
        """Adds each missing reverse edge once; edges that are there stay as they are."""
        e = self.edges.select("src", "dst")
        missing = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().join(e, ["src", "dst"], "left_anti")
        return Graph(e.union(missing), self._given)

    def edge_count(self) -> int:
        return self.edges.count()


def translate(id_col, shards: int, length: int):
    """Internal id of a user id under modulo dealing to ``shards`` intervals of ``length``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(c, F.lit(shards)) * length + F.floor(c / shards)


def translate_back(id_col, shards: int, length: int):
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(c, F.lit(length)) * shards + F.floor(c / length)


def interval_length(ids: DataFrame, shards: int, least: int = 1) -> int:
    """The length of intervals, ``least`` at least, at which ids(id) have internal ids of their own: with shorter ones two ids share one and there is no way back."""
    top = ids.agg(F.max("id")).first()[0]
    return max(least, 0 if top is None else top // shards + 1)


def pack(src, dst):
    """Two 32-bit ids as one long."""
    return F.shiftleft(src.cast("long"), 32).bitwiseOR(dst.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack(packed):
    return F.shiftright(packed, 32).cast("int"), packed.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
