"""Graphs derived from the driver's tables, for queries, tests and benchmarks.

Each is one SELECT that Spark SQL and DuckDB both read; {name} stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.graph import Graph

#: Offset of the second side of a bipartite graph.
SIDE = 10_000_000

USER_SEQ_RAW = "SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, value AS w FROM {events}"
USER_SEQ = f"SELECT src, dst, count(*) AS w FROM ({USER_SEQ_RAW}) r WHERE src <> dst AND dst IS NOT NULL GROUP BY src, dst"
CUST_SUPP = f"SELECT o_custkey AS src, {SIDE} + l_suppkey AS dst, count(*) AS w FROM {{orders}} o JOIN {{lineitem}} l ON o.o_orderkey = l.l_orderkey GROUP BY o_custkey, l_suppkey"
SUPP_PART = f"SELECT l_suppkey AS src, {SIDE} + l_partkey AS dst, count(*) AS w FROM {{lineitem}} l GROUP BY l_suppkey, l_partkey"
COPURCHASE = "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey"
COPURCHASE_DIR = COPURCHASE + " AND a.l_linenumber < b.l_linenumber"
GEO_FOREST = """SELECT 20000000 + c_custkey AS src, CAST(10000000 + c_nationkey AS BIGINT) AS dst FROM {customer} c
UNION ALL SELECT 30000000 + s_suppkey, CAST(10000000 + s_nationkey AS BIGINT) FROM {supplier} s
UNION ALL SELECT CAST(10000000 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT) FROM {nation} n"""
RATINGS = f"SELECT o_custkey AS src, {SIDE} + l_partkey AS dst, CAST(1 + least(4, floor((max(l_quantity) - 1) / 10)) AS DOUBLE) AS rating FROM {{orders}} o JOIN {{lineitem}} l ON o.o_orderkey = l.l_orderkey GROUP BY o_custkey, l_partkey"
TOPICS = "SELECT user_id AS id, event_type AS topic, count(*) AS n FROM {events} e GROUP BY user_id, event_type"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def user_seq_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's user and the next event's. The order is global, but sorted by hour: only one row an hour meets in a task."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", "user_id", "value")
    first = e.groupBy("hour").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("f"))
    after = first.select("hour", F.lead("f.user_id").over(W.orderBy("hour")).alias("next"))
    own = F.lead("user_id").over(W.partitionBy("hour").orderBy("ts", "event_id"))
    return e.withColumn("own", own).join(after, "hour").select(F.col("user_id").alias("src"), F.coalesce("own", "next").alias("dst"), F.col("value").alias("w"))


def user_seq(spark: SparkSession, sf_dir: str) -> Graph:
    raw = user_seq_raw(spark, sf_dir).filter("src <> dst and dst is not null")
    return Graph(raw.groupBy("src", "dst").agg(F.count("*").alias("w")))


def cust_supp(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(frame(spark, sf_dir, CUST_SUPP))


def supp_part(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(frame(spark, sf_dir, SUPP_PART))


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Pairs are dealt by src and told apart there, so programs that start from src need no other shuffle of them."""
    pairs = frame(spark, sf_dir, COPURCHASE.replace("DISTINCT ", "", 1))
    return Graph(pairs.repartition("src").distinct())


def copurchase_dir(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(frame(spark, sf_dir, COPURCHASE_DIR))


def geo_forest(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(frame(spark, sf_dir, GEO_FOREST))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, RATINGS)
