"""Activity counts over an append-only stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window_counts(
    activity: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """Counts per tumbling window and type; later rows than the watermark are dropped.

    Works on a stream and on a table. Counts are combined before the shuffle, so one
    very common type costs one row per task.
    """
    timed = activity.select(F.col(at).cast("timestamp").alias("at"), F.coalesce(F.col(kind), F.lit("other")).alias(kind))
    return (
        timed.withWatermark("at", lateness)
        .groupBy(F.window("at", width), kind)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), kind, "n")
    )


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> object:
    """Append closed windows to a Parquet table, taking all that is there now."""
    return (
        counts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_open_counts(counts: DataFrame, path: str, checkpoint: str) -> object:
    """Write the counts of all windows that a batch changed, open ones too, under the number of the batch.

    A repeated batch replaces its own rows. The table grows by what changes; see :func:`read_open_counts`.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_open_counts(spark: SparkSession, path: str, kind: str = "event_type") -> DataFrame:
    """(window_start, window_end, kind, n) as of the latest batch that touched each window."""
    rows = spark.read.schema(f"window_start TIMESTAMP, window_end TIMESTAMP, {kind} STRING, n BIGINT, batch BIGINT").parquet(path)
    return rows.groupBy("window_start", "window_end", kind).agg(F.max_by("n", "batch").alias("n"))
