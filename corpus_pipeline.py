"""A cleaning pipeline: language, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns the next stage's documents; ``run`` writes each
result to the shared folder and reads it again. All stages but the last keep the columns of
``documents``; the last adds the token columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm import bpe, language, mixing, neardup, pii
from quireworks.llm.common import arrow_rows, held_out, table
from quireworks.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows that a Python worker is sent at once: the stages share the workers' memory, so those that send texts write under this bound.
ROWS = 1000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the classifier rejects go."""
    with arrow_rows(spark, ROWS):
        model = language.fit(docs.where(~held_out(F.col("doc_id"), language.FOLDS, 0)).select("doc_id", "text", "lang"))
        return stage(language.identify(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS), "known-language")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return neardup.keep_one(docs.select(*COLUMNS))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by labels; ``n_chars`` follows the text."""
    model = pii.fit(docs.select("doc_id", "text"))
    clean = pii.redact(docs.select(*COLUMNS), model)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as drawn for equal shares of the sources, shuffled."""
    return mixing.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of each text."""
    vocabulary = bpe.load_vocabulary(bpe.word_bpe_path())
    with arrow_rows(spark, ROWS):
        return stage(bpe.digests(docs.select("doc_id", "text"), vocabulary, bpe.send_lexicon(docs.select("text"), vocabulary)), "token-digests")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: SQL cannot express the stages (language model, trees, BPE); tests/llm/test_pipeline.py checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
