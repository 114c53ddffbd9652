"""Changes to tables as new versions: each function returns the table after the change.

There is no in-place update. Write the result with :func:`quireworks.sources.writers.write_version`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.functions.skew import salted_join

PATCHABLE = ("full_name", "bio", "avatar_url")


def missing_from(papers: DataFrame, existing: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Papers whose file is not there yet."""
    return papers.join(existing.select(key).distinct(), key, "left_anti")


def summary_rows(new: DataFrame, now: Column) -> DataFrame:
    """New summaries with their defaults, ready to append to the summaries table."""
    return new.select(
        F.coalesce("id", F.uuid()).alias("id") if "id" in new.columns else F.uuid().alias("id"),
        "user_id",
        F.coalesce("paper_title", F.lit("")).alias("paper_title"),
        F.coalesce("paper_authors", F.array().cast("array<string>")).alias("paper_authors"),
        "paper_url",
        "arxiv_id",
        "summary_data",
        F.coalesce("model_used", F.lit("LED")).alias("model_used"),
        F.round("processing_time_seconds", 2).cast("decimal(10,2)").alias("processing_time_seconds"),
        F.coalesce("word_count", F.lit(0)).cast("int").alias("word_count"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def activity_rows(summaries: DataFrame, kind: str = "summarize") -> DataFrame:
    """One activity row for each summary just saved."""
    return summaries.select(
        F.uuid().alias("id"),
        "user_id",
        F.lit(kind).alias("activity_type"),
        F.struct(
            F.col("id").alias("summary_id"),
            "paper_title",
            "arxiv_id",
            F.col("processing_time_seconds").cast("double").alias("processing_time"),
        ).alias("activity_data"),
        "created_at",
    )


def patched_values(patches: DataFrame, key: str = "id", allowed: Sequence[str] = PATCHABLE, order: str | None = None) -> DataFrame:
    """(key, allowed columns): one row per key with any new value; text is trimmed.

    Of several patches for a key the last one holds, by the column ``order`` (by its values, if none is given
    or it ties); the others have no effect.
    """
    fields = [c for c in patches.columns if c in allowed]
    if not fields:
        raise ValueError("no valid fields to update")
    texts = {f.name for f in patches.schema if f.dataType.typeName() == "string"}
    new = patches.select(
        key, *([F.col(order).alias("_order")] if order else []), *((F.trim(F.col(c)) if c in texts else F.col(c)).alias(c) for c in fields)
    ).where(F.coalesce(*(F.col(c).cast("string") for c in fields)).isNotNull())
    last = F.max(F.struct(*(["_order"] if order else []), *fields)).alias("_last")
    return new.groupBy(key).agg(last).select(key, *(F.col(f"_last.{c}").alias(c) for c in fields))


def patch(
    base: DataFrame, patches: DataFrame, now: Column, key: str = "id", allowed: Sequence[str] = PATCHABLE, order: str | None = None
) -> DataFrame:
    """Apply patches: allowed columns with a value replace the old one and set ``updated_at``.

    Other columns of a patch are ignored, and a patch without any allowed value changes
    nothing. See :func:`patched_values` for several patches of a key.
    """
    new = patched_values(patches, key, allowed, order)
    fields = [c for c in new.columns if c != key]
    new = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields), F.lit(True).alias("_hit"))
    changes = {c: F.coalesce(f"_new_{c}", c) for c in fields}
    changes["updated_at"] = F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    return base.join(new, key, "left").withColumns(changes).select(*base.columns)


def owner_delete(table: DataFrame, requests: DataFrame, key: str = "id", owner: str = "user_id") -> DataFrame:
    """The table without rows whose deletion their owner asked for; other requests have no effect."""
    return table.join(requests.select(key, owner).distinct(), [key, owner], "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, key: str = "user_id") -> DataFrame:
    """The child table without rows of deleted parents."""
    return child.join(deleted.select(key).distinct(), key, "left_anti")


def validate_uploads(
    files: DataFrame,
    name: str = "path",
    length: str = "length",
    extensions: Sequence[str] = ("pdf",),
    max_bytes: int = 50 * 1024 * 1024,
) -> DataFrame:
    """Add ``reject_reason``: null for files that may be processed."""
    file_name = F.element_at(F.split(F.coalesce(name, F.lit("")), "/"), -1)
    extension = F.lower(F.element_at(F.split(file_name, r"\."), -1))
    return files.withColumn(
        "reject_reason",
        F.when(file_name == "", "no file selected")
        .when(~F.contains(file_name, F.lit(".")) | ~extension.isin(*extensions), "file type not allowed")
        .when(F.col(length) > max_bytes, "file too large"),
    )


def split_batch(items: DataFrame, existing: DataFrame, path: str = "path") -> DataFrame:
    """Add ``success`` and ``error``: items whose file is missing are marked, the others go on.

    As in the batch outcome, ``success`` stays null for an invalid path.
    """
    known = existing.select(path).distinct().withColumn("_known", F.lit(True))
    # salted by the whole item: items without a path, or with the same one, may be many
    return (
        salted_join(items, known, [path], items.columns, "left")
        .withColumn("success", F.col("_known"))
        .withColumn("error", F.when(F.col("_known").isNull(), F.lit("Invalid PDF path")))
        .select(*items.columns, "success", "error")
    )


def batch_outcome(items: DataFrame) -> DataFrame:
    """Counts of all, completed and failed items; no success flag counts as failed."""
    done = F.coalesce("success", F.lit(False))
    return items.agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(~done).alias("failed")
    )


def orphans(child: DataFrame, parent: DataFrame, child_key: str = "user_id", parent_key: str = "id") -> DataFrame:
    """Child rows that name a parent which does not exist."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def duplicate_keys(table: DataFrame, *keys: str) -> DataFrame:
    """Key values held by more than one row."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
