"""Joins that stay balanced when one key holds a large share of the rows, and tasks that stay small however many rows there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 4

#: Characters of text that one task takes apart; as rows its words fill about fifty times that room.
TASK_CHARS = 4_000_000


def tasks_for(texts: DataFrame, text: str = "text", chars: int = TASK_CHARS) -> int:
    """How many tasks the texts need, so that none has much more than ``chars``; their lengths are read when this is called.

    Adaptive execution merges partitions by their size before the texts are taken apart, so it would make fewer
    and larger tasks. A number given to ``repartition`` is kept.
    """
    total = texts.agg(F.sum(F.length(text))).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-total // chars))


def buckets_for(texts: DataFrame, text: str = "text", chars: int = TASK_CHARS) -> int:
    """As :func:`tasks_for`, for a table in buckets: not fewer than the session's shuffle partitions, not more than Spark allows."""
    conf = texts.sparkSession.conf
    most = int(conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    total = texts.agg(F.sum(F.length(text))).first()[0] or 0
    return min(most, max(int(conf.get("spark.sql.shuffle.partitions")), -(-total // chars)))


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join many rows per key with one row per key.

    Left rows get a salt from the ``spread_by`` columns and right rows are repeated per
    salt, so a hot key goes to several tasks. The salt also puts a shuffle right below
    both sides of the join; without it an aggregated right side would keep adaptive
    execution from splitting hot partitions further. A right side that turns out small
    is still broadcast, by its measured size.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    copies = right.withColumn("_salt", F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(salts)))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
