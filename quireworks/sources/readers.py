"""Readers for papers, spans, document files, saved summaries and relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.functions import text as tx
from quireworks.operators import library
from quireworks.sources import schemas


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """A Parquet table; with ``spread_by`` its rows are dealt out by that column."""
    df = spark.read.parquet(path)
    return df.repartition(spread_by) if spread_by else df


def read_papers(
    spark: SparkSession, path: str, condition: Column | None = None, max_results: int | None = None, fmt: str = "json"
) -> DataFrame:
    """Paper metadata from a dump, newest first. Without a condition the default category is read."""
    papers = spark.read.schema(schemas.PAPERS).format(fmt).load(path)
    condition = library.paper_filter() if condition is None else condition
    papers = papers.withColumn("published", tx.published_at(F.col("published")))
    return library.search_papers(papers, condition, max_results)


def with_paper_defaults(papers: DataFrame, today: Column) -> DataFrame:
    """Defaults for papers that came as an uploaded file (needs ``pdf_path``)."""
    stem = F.regexp_replace(tx.last_path_part(F.col("pdf_path")), r"\.[^.]*$", "")
    return papers.withColumns(
        {
            "title": F.coalesce("title", stem),
            "authors": F.coalesce("authors", F.array().cast("array<string>")),
            "arxiv_id": F.coalesce("arxiv_id", F.lit("uploaded")),
            "published": F.coalesce("published", F.date_format(today, "yyyy-MM-dd")),
            "primary_category": F.coalesce("primary_category", F.lit("Unknown")),
        }
    )


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SPANS).parquet(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Document files by name, size and time. Their content is not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return found.load(path).drop("content")


def read_saved_summaries(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Saved summaries with their id and all fields.

    Either ``summary_<id>.json`` files with one summary each, or JSON lines as
    ``write_records`` leaves them, where the paper id stands for the summary's.
    """
    reader = spark.read.schema(schemas.SUMMARY_FILE)
    if not one_per_file:
        return reader.json(path).withColumn("id", F.col("arxiv_id"))
    files = reader.option("multiLine", True).option("pathGlobFilter", "summary_*.json").json(path)
    return files.withColumn("id", F.regexp_extract(F.input_file_name(), r"summary_([^/]*)\.json$", 1))


def list_summaries(saved: DataFrame) -> DataFrame:
    """The overview of saved summaries: up to three authors and the number of sections."""
    return saved.select(
        F.col("id").alias("summary_id"),
        "title",
        F.coalesce(F.slice("authors", 1, 3), F.array().cast("array<string>")).alias("authors"),
        "arxiv_id",
        "published",
        F.coalesce(F.size("sections_found"), F.lit(0)).alias("sections"),
    )
