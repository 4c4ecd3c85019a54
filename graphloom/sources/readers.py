"""Graph files to DataFrames, all split by Spark's own readers.

Edges are (src, dst, value) with value the raw token, null where a line has
none; ``parse_value`` turns it into a Column of the wanted type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number(token: Column) -> Column:
    """A token as a double, 0 where there is none; a malformed one is an error."""
    return F.coalesce(token.cast("double"), F.lit(0.0))


def _finish(edges: DataFrame, parse_value: Callable[[Column], Column] | None) -> DataFrame:
    return edges.withColumn("value", parse_value(F.col("value"))) if parse_value else edges


def _data_lines(spark: SparkSession, path: str, comment: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    return lines.filter((F.length("value") > 2) & ~F.col("value").startswith(comment))


def read_edge_list(spark: SparkSession, path: str, parse_value: Callable | None = None) -> DataFrame:
    """Lines ``src dst [value]`` split by tab, else by a space; comments start with #.

    Lines of another number of tokens are skipped, ids that are no integers are errors.
    """
    tab = F.contains(F.col("value"), F.lit("\t"))
    t = F.when(tab, F.split("value", "\t")).otherwise(F.split("value", " "))
    rows = _data_lines(spark, path, "#").select(t.alias("t")).filter(F.size("t").isin(2, 3))
    return _finish(rows.select(F.get("t", F.lit(0)).cast("long").alias("src"), F.get("t", F.lit(1)).cast("long").alias("dst"), F.get("t", F.lit(2)).alias("value")), parse_value)


def read_adjacency(spark: SparkSession, path: str, bad: str = "failfast") -> DataFrame:
    """Lines ``id n d1 ... dn``. A line whose count is wrong is an error, or dropped with bad="drop"."""
    rows = _data_lines(spark, path, "#").select(F.split(F.trim("value"), r"[\t ]+").alias("t"))
    right = F.size("t") == F.get("t", F.lit(1)).cast("int") + 2
    if bad == "failfast":
        rows = rows.filter(F.when(right, True).otherwise(F.raise_error(F.concat(F.lit("wrong neighbour count: "), F.array_join("t", " ")))))
    elif bad == "drop":
        rows = rows.filter(F.coalesce(F.size("t") == F.get("t", F.lit(1)).try_cast("int") + 2, F.lit(False)))
    else:
        raise ValueError(f"bad: {bad}")
    far = F.explode(F.slice("t", F.lit(3), F.greatest(F.size("t") - 2, F.lit(0))))
    return rows.select(F.get("t", F.lit(0)).cast("long").alias("src"), far.alias("d")).select("src", F.col("d").cast("long").alias("dst"), F.lit(None).cast("string").alias("value"))


def read_matrix_market(spark: SparkSession, path: str, parse_value: Callable | None = number) -> tuple[DataFrame, tuple[int, int, int]]:
    """(edges, (left, right, nonzeros)) of a coordinate file: left ids from 0, right ids after them."""
    lines = spark.read.text(path)
    head = lines.filter(F.col("value").startswith("%%")).first()
    if head is None or "matrix coordinate real general" not in head[0].lower():
        raise ValueError("not a MatrixMarket file of kind: matrix coordinate real general")
    data = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = data.first()  # the first data line of a file holds its size
    left, right, nonzeros = (int(x) for x in size[0].split())
    t = F.split(F.trim("value"), r"\s+")
    rows = data.filter(F.col("value") != size[0]).select(t.alias("t"))
    same = data.filter(F.col("value") == size[0]).count() - 1  # an entry can look like the size line
    if same > 0:
        rows = rows.union(spark.range(same).select(F.split(F.lit(size[0].strip()), r"\s+").alias("t")))
    src, dst = F.get("t", F.lit(0)).cast("long") - 1, F.lit(left) + F.get("t", F.lit(1)).cast("long") - 1
    return _finish(rows.select(src.alias("src"), dst.alias("dst"), F.element_at("t", -1).alias("value")), parse_value), (left, right, nonzeros)


def read_delimited(spark: SparkSession, path: str, parse_value: Callable | None = None) -> DataFrame:
    """A file, or the part-* files of a folder: tokens split by runs of tabs, spaces and commas.

    Lines with bad numbers or fewer than two tokens are skipped; a value counts only where there are exactly three.
    """
    reader = spark.read
    files = reader.option("pathGlobFilter", "part-*").text(path) if _is_folder(spark, path) else reader.text(path)
    rows = files.filter(~F.col("value").startswith("#")).select(F.split(F.trim("value"), r"[\t ,]+").alias("t")).filter(F.size("t") >= 2)
    rows = rows.select(F.get("t", F.lit(0)).try_cast("long").alias("src"), F.get("t", F.lit(1)).try_cast("long").alias("dst"), F.when(F.size("t") == 3, F.get("t", F.lit(2))).alias("value"))
    return _finish(rows.filter("src is not null and dst is not null"), parse_value)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def read_graph(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Edges by the name of the format: edgelist (the default), adjlist or adjacency..., matrixmarket, delimited."""
    kind = (kind or "edgelist").lower()
    if kind == "edgelist":
        return read_edge_list(spark, path, **options)
    if kind == "adjlist" or kind.startswith("adjacency"):
        return read_adjacency(spark, path, **options)
    if kind in ("matrixmarket", "mm"):
        return read_matrix_market(spark, path, **options)[0]
    if kind == "delimited":
        return read_delimited(spark, path, **options)
    raise ValueError(f"unknown graph format: {kind}")


def read_topic_seeds(spark: SparkSession, index: str) -> DataFrame:
    """(id, topic) from an index of lines ``topic<TAB>file``; the first column of a file is the vertex id."""
    out = None
    for r in spark.read.csv(index, sep="\t", schema="topic string, file string").collect():  # one line a topic
        rows = spark.read.text(r["file"]).select(F.get(F.split("value", "\t"), F.lit(0)).try_cast("long").alias("id"), F.lit(r["topic"]).alias("topic")).filter("id is not null")
        out = rows if out is None else out.union(rows)
    return out


def read_topic_weights(spark: SparkSession, index: str) -> DataFrame:
    """(id, topic, weight) from an index as above with files ``id, _, weight``; files named with :sqr are squared."""
    out = None
    for r in spark.read.csv(index, sep="\t", schema="topic string, file string").collect():
        name, square = r["file"].removesuffix(":sqr"), r["file"].endswith(":sqr")
        t = F.split("value", "\t")
        w = F.get(t, F.lit(2)).cast("double")
        rows = spark.read.text(name).select(F.get(t, F.lit(0)).cast("long").alias("id"), F.lit(r["topic"]).alias("topic"), (w * w if square else w).alias("weight"))
        out = rows if out is None else out.union(rows)
    return out


def _records(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(content, place) of the records of ``width`` bytes in binary files, split at whole records and kept in the JVM."""
    jvm = spark._jvm
    placed = spark._jsc.binaryRecords(path, width).zipWithIndex()
    kinds = jvm.org.apache.spark.sql.Encoders
    return DataFrame(spark._jsparkSession.createDataset(placed.rdd(), kinds.tuple(kinds.BINARY(), kinds.LONG())).toDF(), spark).toDF("content", "place")


def read_walk_log(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(walk_id, hop, vertex) of binary 10-byte records: int walk, short hop, int vertex, big-endian. A file that ends inside a record is an error."""
    raw = _records(spark, f"{path}/walks_*" if _is_folder(spark, path) else path, 10)
    part = lambda a, n: F.conv(F.hex(F.substring("content", a + 1, n)), 16, 10).cast("long")
    signed = lambda v, bits: F.when(v >= 1 << (bits - 1), v - (1 << bits)).otherwise(v)
    rows = raw.select(signed(part(0, 4), 32).alias("walk_id"), signed(part(4, 2), 16).alias("hop"), signed(part(6, 4), 32).alias("vertex"))
    if first is not None:
        rows = rows.filter(F.col("walk_id") >= first)
    return rows if last is None else rows.filter(F.col("walk_id") <= last)


def read_names(spark: SparkSession, path: str, width: int = 16) -> DataFrame:
    """(id, name) of a file of fixed-width name records, the id being the place of the record. A file that ends inside a record is an error."""
    return _records(spark, path, width).select(F.col("place").alias("id"), F.trim(F.regexp_replace(F.decode("content", "UTF-8"), "\\x00+$", "")).alias("name"))
