"""Statistics that grow by appending: one small row per user and day, merged when read.

New summaries are reduced to such rows (:func:`user_days`) and appended; earlier summaries are never read
again. All columns merge by sums, maxima and the days themselves, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.functions import text as tx

_SUMS = ("n", "n_rows", "seconds", "n_seconds", "words")


def user_days(summaries: DataFrame) -> DataFrame:
    """(user_id, day, n, n_rows, seconds, n_seconds, words, last) of new summaries."""
    return summaries.groupBy("user_id", F.to_date("created_at").alias("day")).agg(
        F.count("id").alias("n"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("processing_time_seconds").alias("seconds"),
        F.count("processing_time_seconds").alias("n_seconds"),
        F.sum("word_count").alias("words"),
        F.max("created_at").alias("last"),
    )


def merged(states: DataFrame) -> DataFrame:
    """One row per user and day of rows appended at different times; also what a compaction writes."""
    return states.groupBy("user_id", "day").agg(*(F.sum(c).cast(states.schema[c].dataType).alias(c) for c in _SUMS), F.max("last").alias("last"))


def user_stats(users: DataFrame, states: DataFrame) -> DataFrame:
    """As ``library.user_summary_stats``, from the states alone. Days are set as bits of a month before they meet by user."""
    months = states.groupBy("user_id", F.trunc("day", "month").alias("month")).agg(
        *(F.sum(c).alias(c) for c in _SUMS),
        F.max("last").alias("last"),
        F.bit_or(F.expr("1 << (dayofmonth(day) - 1)")).alias("days"),
    )
    mean = (F.sum("seconds") / F.sum("n_seconds")).cast("decimal(14,6)")
    per_user = months.groupBy("user_id").agg(
        F.sum("n").alias("total_summaries"),
        F.when(F.sum("n_seconds") > 0, mean).alias("avg_processing_time"),
        F.sum("words").alias("total_words_processed"),
        F.max("last").alias("last_summary_date"),
        F.sum(F.coalesce(F.bit_count("days"), F.lit(0))).cast("bigint").alias("active_days"),
    )
    none = F.lit(0).cast("bigint")
    return (
        users.select(F.col("id").alias("user_id"), "email")
        .join(per_user, "user_id", "left")
        .withColumns({c: F.coalesce(c, none) for c in ("total_summaries", "active_days")})
    )


def monthly_counts(states: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """(user_id, month, n) of the last ``days`` days before the day ``as_of``."""
    recent = states.where(F.col("day") >= F.date_sub(as_of.cast("date"), days))
    return recent.groupBy("user_id", tx.month_key(F.col("day")).alias("month")).agg(F.sum("n_rows").alias("n"))
