"""Weighted text search from a table of postings: for each word the papers that hold it, with its weight in them.

``library.weighted_search`` goes through every paper; here a search opens only the buckets of its words. A
word's postings are cut into blocks by paper, so a word that every paper holds is many rows in many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.functions.lexicon import STOP_WORDS
from quireworks.functions.skew import tasks_for
from quireworks.operators.library import title_tokens
from quireworks.staging import stage


@dataclass(frozen=True)
class Postings:
    """Postings below ``path``: ``bucket=<hash of the word>/`` with (term, ids, weights) in blocks of about ``block`` papers."""

    path: str
    buckets: int = 64
    block: int = 1024

    def build(
        self, papers: DataFrame, title: str = "title", authors: str = "authors", weights: tuple[float, float] = (1.0, 0.4), key: str = "id"
    ) -> Postings:
        """Words of title and authors with their weights added up; stop words are left out.

        The papers are spread by id before they are taken apart, over as many tasks as their length asks for, so
        their words are weighed in place. The weighed words are written, as they are read twice.
        """
        tasks = tasks_for(papers.select(F.concat_ws(" ", title, F.array_join(authors, " ")).alias("text")))
        parts = [F.transform(title_tokens(c), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"))) for c, w in ((F.col(title), weights[0]), (F.array_join(authors, " "), weights[1]))]
        spread = papers.withColumn("id", F.col(key).cast("bigint")).select("id", title, authors).repartition(tasks, "id")
        words = spread.select("id", F.explode(F.concat(*parts)).alias("p")).where(~F.col("p.term").isin(list(STOP_WORDS)))
        weighed = stage(words.groupBy("p.term", "id").agg(F.round(F.sum("p.w"), 6).alias("weight")), "weighed-words")
        many = weighed.select("id").distinct().agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / self.block)).alias("n")).scalar()
        blocks = (
            weighed.withColumn("part", F.pmod(F.xxhash64("id"), many))
            .groupBy("term", "part")
            .agg(F.sort_array(F.collect_list(F.struct("id", "weight"))).alias("items"))
            .select("term", F.col("items.id").alias("ids"), F.col("items.weight").alias("weights"), F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket"))
        )
        blocks.write.partitionBy("bucket").parquet(self.path)
        return self

    def search(self, spark: SparkSession, terms: Sequence[str], limit: int | None = None) -> DataFrame:
        """(id, score) of the papers with any of the words, best first; reads the buckets of the words only."""
        wanted = sorted({t.lower() for t in terms} - set(STOP_WORDS))
        asked = spark.createDataFrame([(t,) for t in wanted], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket"))
        buckets = sorted({r["bucket"] for r in asked.collect()})  # one for each word of the search
        blocks = spark.read.parquet(self.path).where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
        found = blocks.select(F.explode_outer(F.arrays_zip("ids", "weights")).alias("p")).where("p IS NOT NULL")
        scored = found.groupBy(F.col("p.ids").alias("id")).agg(F.round(F.sum("p.weights"), 6).alias("score")).orderBy(F.desc("score"), "id")
        return scored.limit(limit) if limit is not None else scored
