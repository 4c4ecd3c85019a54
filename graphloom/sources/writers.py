"""DataFrames to graph files; every writer runs on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph


def write_graph(graph: Graph, path: str, partitions: int | None = None) -> None:
    """Parquet of edges in ranges of src, sorted, so that files and row groups skip by src; degrees and given vertex values beside them."""
    edges = graph.edges.repartitionByRange(partitions, "src", "dst") if partitions else graph.edges.repartitionByRange("src", "dst")
    edges.sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    graph.degrees().write.mode("overwrite").parquet(f"{path}/degrees")
    given = graph._given if graph._given is not None else graph.edges.select(F.col("src").alias("id")).limit(0)
    given.write.mode("overwrite").parquet(f"{path}/vertices")


def read_stored(spark, path: str) -> Graph:
    given = spark.read.parquet(f"{path}/vertices")
    return Graph(spark.read.parquet(f"{path}/edges"), given if given.take(1) else None)


def lookup(spark, path: str, *ids: int) -> DataFrame:
    """Out-edges of a few vertices of a stored graph; the filter reaches the scan, which skips all other ranges."""
    return spark.read.parquet(f"{path}/edges").filter(F.col("src").isin(*ids))


def write_values(values: DataFrame, path: str) -> None:
    """Vertex values (id, value columns), in ranges of id."""
    values.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def register(graph: Graph, name: str) -> None:
    """Temporary views name_edges, name_vertices and name_degrees, for SQL."""
    for what, df in (("edges", graph.edges), ("vertices", graph.vertices), ("degrees", graph.degrees())):
        df.createOrReplaceTempView(f"{name}_{what}")


def degree_totals(degrees: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return degrees.agg(F.count("*").alias("n"), F.coalesce(F.sum("in_degree"), zero).alias("sum_in"), F.coalesce(F.sum("out_degree"), zero).alias("sum_out"))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws("\t", "src", "dst").alias("value"))


def write_edge_list(edges: DataFrame, path: str) -> None:
    edge_lines(edges).write.mode("overwrite").text(path)


def cassovary_lines(graph: Graph) -> DataFrame:
    """(id, value): a vertex, its out-degree and its out-neighbours, one a line; vertices with out-edges only."""
    out = graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("d"))
    return out.select("id", F.concat(F.concat_ws(" ", "id", F.size("d")), F.lit("\n"), F.array_join(F.col("d").cast("array<string>"), "\n")).alias("value"))


def write_cassovary(graph: Graph, path: str) -> None:
    cassovary_lines(graph).select("value").write.mode("overwrite").text(path)


def write_histogram(histogram: DataFrame, path: str) -> None:
    """Lines ``label,count``."""
    histogram.select("label", "count").write.mode("overwrite").csv(path)


def factor_lines(factors: DataFrame) -> DataFrame:
    """The lines of a dense MatrixMarket file, in order: the head, the shape, the numbers of each vertex in turn, by id."""
    shape = factors.agg(F.coalesce(F.max(F.size("features")), F.lit(0)).alias("k"), F.count("*").alias("n"))
    no_id = F.lit(None).cast("long")
    head = shape.select(no_id.alias("id"), F.lit(0).alias("k"), F.lit("%%MatrixMarket matrix array real general").alias("value"))
    size = shape.select(no_id.alias("id"), F.lit(1).alias("k"), F.concat_ws(" ", "k", "n").alias("value"))
    body = factors.select(F.col("id").cast("long").alias("id"), F.posexplode("features").alias("k", "x")).select("id", "k", F.col("x").cast("string").alias("value"))
    return head.union(size).union(body).orderBy(F.col("id").asc_nulls_first(), "k").select("value")


def write_factors(factors: DataFrame, path: str) -> None:
    """One MatrixMarket file in parts: their names are in order, so the parts put together are the file."""
    factor_lines(factors).write.mode("overwrite").text(path)


def write_top_visits(top: DataFrame, path: str) -> None:
    top.write.mode("overwrite").parquet(path)


def write_walks(walks: DataFrame, path: str) -> None:
    walks.select("source", "pos").write.mode("overwrite").parquet(path)


def write_topic_lists(top: DataFrame, path: str) -> None:
    """Lines ``id<TAB>topic<TAB>value``, a folder for each topic."""
    top.select(F.concat_ws("\t", "id", "topic", "score").alias("value"), F.col("topic").alias("of")).write.mode("overwrite").partitionBy("of").text(path)


def write_cores(cores: DataFrame, path: str) -> None:
    """Lines ``id, core`` from the largest core down; the number of vertices in a file of its own."""
    cores.agg(F.count("*").cast("string").alias("value")).write.mode("overwrite").text(f"{path}/head")
    cores.orderBy(F.col("core").desc(), "id").select(F.concat_ws(", ", "id", "core").alias("value")).write.mode("overwrite").text(f"{path}/body")
