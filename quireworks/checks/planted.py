"""Inputs derived from the given tables, for operators whose input the tables do not hold directly.

The prose of ``documents`` has no headings, citations or entity names, so they are
planted by rule. ``quireworks.checks.sql`` derives the same rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.sources.readers import read_table

# What is appended to a document's text, by doc_id % 6.
PLANTED = (
    "We train ResNet-50 and a Vision Transformer on ImageNet-1k [1, 2].",
    "BERT and GPT-4 reach accuracy 0.91 and F1-score 0.88 (3).",
    "First we collect the MNIST data set. Then we train small LSTM models on it. Finally we evaluate recall on CIFAR-10.",
    "See Fig. 3 and Table 2 at https://arxiv.org/abs/2511.12345v1 or mail a.b@example.com.",
    "PyTorch and scikit-learn were used. Recall and recall differ.",
    "No entities here.",
)

# Headings that replace every fourth line, in turn.
HEADINGS = (
    "Abstract",
    "1 Introduction",
    "II. Related Work",
    "3.1 Proposed Method",
    "Experimental Setup",
    "Results",
    "6 Discussion",
    "Conclusion",
    "References",
)


def table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", spread_by)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id")


def _planted() -> Column:
    return F.element_at(F.array(*(F.lit(p) for p in PLANTED)), (F.col("doc_id") % 6 + 1).cast("int"))


def planted_texts(spark: SparkSession, sf_dir: str, first: bool = False) -> DataFrame:
    """(doc_id, text) with the planted part at the end, or at the start."""
    parts = (_planted(), F.col("text")) if first else (F.col("text"), _planted())
    return documents(spark, sf_dir).select("doc_id", F.concat_ws(" ", *parts).alias("text"))


def planted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout spans: every fourth line of a document becomes a heading, the next gets a planted sentence, each line is two spans."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    is_heading = F.col("n") % 4 == 0
    turn = (F.floor(F.col("n") / 4) % 9 + 1).cast("int")
    shaped = lines.select(
        "doc_id",
        "n",
        is_heading.alias("is_heading"),
        F.when(is_heading, F.element_at(F.array(*(F.lit(h) for h in HEADINGS)), turn))
        .when(F.col("n") % 4 == 1, F.concat_ws(" ", "line", F.element_at(F.array(*(F.lit(p) for p in PLANTED)), ((F.col("doc_id") + F.col("n")) % 6 + 1).cast("int"))))
        .otherwise(F.col("line"))
        .alias("line"),
    )
    half = F.floor(F.length("line") / 2).cast("int")
    halves = F.array(
        F.struct(F.lit(0).alias("span_no"), F.substring("line", F.lit(1), half).alias("text")),
        F.struct(F.lit(1).alias("span_no"), F.substring("line", half + 1, F.length("line")).alias("text")),
    )
    return shaped.select(
        "doc_id",
        F.floor(F.col("n") * 12 / 720).cast("int").alias("page"),
        (2 * F.floor(F.col("n") / 4) + F.when(F.col("is_heading"), 0).otherwise(1)).cast("int").alias("block_no"),
        F.lit(0).alias("block_type"),
        F.col("n").alias("line_no"),
        F.inline(halves),
        F.when(F.col("is_heading"), F.lit(12.5)).otherwise(10.0 + (F.col("doc_id") % 3) * 0.5).alias("size"),
        F.when(F.col("is_heading"), F.lit("Times-Bold")).otherwise(F.lit("Times-Roman")).alias("font"),
        F.lit(72.0).alias("x0"),
        (F.col("n") * 12 % 720).cast("double").alias("y0"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users, and suppliers as users who never saved a summary."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("email"),
        F.col("c_name").alias("full_name"),
        F.col("c_mktsegment").alias("bio"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        (-F.col("s_suppkey")).alias("id"), F.col("s_name").alias("email"), F.col("s_name").alias("full_name"), F.lit(None).cast("string").alias("bio")
    )
    return customers.unionByName(suppliers)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as summaries; the word count of a summary is the quantity of its lines."""
    words = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("word_count"))
    )
    return orders_as_summaries(spark, sf_dir).join(words, "id", "left")


def orders_as_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("paper_title"),
        F.col("o_orderstatus").alias("arxiv_id"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("processing_time_seconds"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as activity; every ninth has no type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("activity_type"),
        F.col("ts").cast("timestamp").alias("created_at"),
        "props",
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a paper catalogue: the words of the name are its authors."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_partkey").cast("string").alias("arxiv_id"),
        F.col("p_name").alias("title"),
        F.split("p_name", " ").alias("authors"),
        F.col("p_brand").alias("summary"),
        F.col("p_type").alias("primary_category"),
        F.col("p_retailprice").alias("published"),
    )
