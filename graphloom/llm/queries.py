"""The queries of this subpackage: thin wrappers of its operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm import chat, decontaminate, langid, licenses, mixing, quality_knn, quality_rules, setjoin, substrings, urls
from graphloom.llm.common import table
from graphloom.plans.scratch import Scratch


def op1_langid_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op3_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reply trees without branches: each turn answers the one before it."""
    own = spark.createDataFrame([(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    order = W.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    nodes = rows.select(F.col("conv_id").alias("tree"), F.row_number().over(order).alias("node"), "role", "text", F.lit(None).cast("double").alias("score"))
    nodes = nodes.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    return chat.digest(chat.format_trees(nodes, Scratch(spark, "op3")))


def op4_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~quality_knn.held_out())
    found = quality_knn.classify(docs, quality_knn.train(docs, labels))
    return found.select("doc_id", quality_knn.held_out().alias("held_out"), "score", "predicted")


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op6"))


def op7_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.components(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op8"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.page_outcomes(pages, table(spark, sf_dir, "labels")), Scratch(spark, "op9"))


def op10_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_langid_ftrl, op2_entropy_mix, op3_chat_trees, op4_superkmer_dedup, op5_quality_knn, op6_latent_decontamination, op7_prefix_tree_join, op8_quality_rules, op9_url_reputation, op10_licence_rules)}


def oracles() -> dict[str, str]:
    return {"op3_chat_trees": chat.oracle(), "op4_superkmer_dedup": substrings.oracle(), "op7_prefix_tree_join": setjoin.oracle(), "op8_quality_rules": quality_rules.oracle(), "op9_url_reputation": urls.oracle(), "op10_licence_rules": licenses.oracle()}
