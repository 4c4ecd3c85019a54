"""Neighbourhood queries; all take many query vertices at once, keyed by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions.draws import draw
from graphloom.functions.values import top_k_per_group
from graphloom.graph import Graph


#: Arrays over which the out-edges of a vertex are spread.
CHUNKS = 4


def out_edges(graph: Graph, ids: DataFrame) -> DataFrame:
    """(id, nbr, ...) of the out-edges of ids(id)."""
    rest = [c for c in graph.edges.columns if c not in ("src", "dst")]
    return graph.edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("nbr"), *rest)


def out_neighbor_lists(graph: Graph, ids: DataFrame) -> DataFrame:
    """(id, neighbors): sorted, duplicates kept, empty where there are none."""
    got = out_edges(graph, ids).groupBy("id").agg(F.sort_array(F.collect_list("nbr")).alias("neighbors"))
    return ids.select("id").distinct().join(got, "id", "left").select("id", F.coalesce("neighbors", F.array().cast(dict(got.dtypes)["neighbors"])).alias("neighbors"))


def out_neighbor_set(graph: Graph, ids: DataFrame) -> DataFrame:
    """(nbr): the distinct out-neighbours of all ids together."""
    return out_edges(graph, ids).select("nbr").distinct()


def out_neighbor_counts(graph: Graph, ids: DataFrame) -> DataFrame:
    """(nbr, count): how many out-edges of ids reach each neighbour."""
    return out_edges(graph, ids).groupBy("nbr").agg(F.count("*").alias("count"))


def neighbors_with_values(graph: Graph, ids: DataFrame, value: str) -> DataFrame:
    return out_edges(graph, ids).select("id", "nbr", F.col(value).alias("value"))


def friends_of_friends(graph: Graph, ids: DataFrame, top: int = 20, fan_out: int | None = None, seed: int = 1, ranks: DataFrame | None = None) -> DataFrame:
    """(id, rank, fof, count): the most reached friends of friends that are neither the vertex nor its friends.

    With fan_out, so many friends are drawn by a seeded hash where there are
    more; with ranks(id, rank) too, without replacement in proportion to their
    rank (a friend of u gets the key ln(u) / rank; those without a rank come last).
    """
    friends = out_edges(graph, ids).select("id", "nbr").distinct()
    asked = friends
    if fan_out:
        u = draw(seed, F.col("id"), F.col("nbr"))
        if ranks is not None:
            asked = friends.join(ranks.select(F.col("id").alias("nbr"), "rank"), "nbr", "left").select("id", "nbr", (F.log(u + F.lit(2.0**-33)) / F.when(F.col("rank") > 0, F.col("rank"))).alias("key"))
            w = W.partitionBy("id").orderBy(F.col("key").desc_nulls_last(), "nbr")
        else:
            w = W.partitionBy("id").orderBy(u, "nbr")
        asked = asked.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= fan_out).select("id", "nbr")
    # what a friend knows goes to the asking vertex as one array, and all of a vertex is counted where it arrives
    known = _lists(graph.edges).select(F.col("src").alias("nbr"), "far")
    two = asked.join(known, "nbr").select("id", "far", F.lit(False).alias("near"))
    own = _lists(friends.select(F.col("id").alias("src"), F.col("nbr").alias("dst"))).select(F.col("src").alias("id"), "far", F.lit(True).alias("near"))
    rows = two.union(own).repartition("id").select("id", "near", F.explode("far").alias("fof")).filter("fof <> id")
    counts = rows.groupBy("id", "fof").agg(F.count("*").alias("count"), F.max("near").alias("near"))
    return top_k_per_group(counts.filter("not near").select("id", "fof", "count"), ["id"], "count", top, key="fof").select("id", "rank", "fof", "count")


def _lists(edges: DataFrame) -> DataFrame:
    """(src, far): the ends of out-edges in arrays, those of a hub in up to CHUNKS of them, dealt by src."""
    rows = edges.select("src", "dst").repartition("src")
    return rows.groupBy("src", F.pmod(F.xxhash64("dst"), F.lit(CHUNKS)).alias("chunk")).agg(F.collect_list("dst").alias("far")).select("src", "far")


def with_names(df: DataFrame, names: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``name`` from names(id, name); the id itself where there is none."""
    n = names.select(F.col("id").alias(key), "name")
    return df.join(n, key, "left").withColumn("name", F.coalesce("name", F.col(key).cast("string")))
