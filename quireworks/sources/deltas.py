"""Tables that change by small files: patches and deletions are written beside a version and applied when it is read.

``<path>/version=<n>`` are whole versions (see ``writers``); ``<path>/changes/base=<n>/version=<m>`` are the
changes to version n, in the order of m, each as large as the change and not as the table. A reader joins
the version with its changes; :meth:`DeltaTable.compact` writes what it reads as the next version, which
begins without changes. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.functions.skew import salted_join
from quireworks.operators.maintenance import PATCHABLE, patched_values
from quireworks.sources import writers


@dataclass(frozen=True)
class DeltaTable:
    """A table below ``path`` with unique ``key``, rows of an ``owner``, and columns that patches may change."""

    path: str
    key: str = "id"
    owner: str | None = "user_id"
    patchable: Sequence[str] = field(default=PATCHABLE)

    def create(self, df: DataFrame) -> int:
        return writers.write_version(df, self.path)

    def base(self, spark: SparkSession) -> int:
        return writers.versions(spark, self.path)[-1]

    def _changes_path(self, spark: SparkSession) -> str:
        return f"{self.path}/changes/base={self.base(spark)}"

    def _add(self, kind: str, rows: DataFrame) -> int:
        """Write a change; its rows carry the key, or the owner whose rows all go, and new values."""
        table = writers.read_version(rows.sparkSession, self.path)
        names = [c for c in (self.key, self.owner, *self.patchable, "updated_at") if c in table.columns]
        types = dict(table.dtypes)
        columns = [(F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in names]
        return writers.write_version(rows.select(F.lit(kind).alias("change"), *columns), self._changes_path(rows.sparkSession))

    def patch(self, patches: DataFrame, now: Column) -> int:
        """New values by key; the rules are those of :func:`maintenance.patch`."""
        return self._add("patch", patched_values(patches, self.key, self.patchable).withColumn("updated_at", now))

    def owner_delete(self, requests: DataFrame) -> int:
        """Rows that their owner wants deleted: (key, owner)."""
        return self._add("delete", requests.select(self.key, self.owner).distinct())

    def cascade_delete(self, deleted: DataFrame) -> int:
        """All rows of deleted owners: (owner)."""
        return self._add("cascade", deleted.select(self.owner).distinct())

    def read(self, spark: SparkSession, number: int | None = None) -> DataFrame:
        """The table as it is now, or as it was after change ``number`` of its version."""
        table = writers.read_version(spark, self.path)
        done = [n for n in writers.versions(spark, self._changes_path(spark)) if number is None or n <= number]
        if not done:
            return table
        root = self._changes_path(spark)
        changes = spark.read.option("basePath", root).parquet(*(f"{root}/version={n}" for n in done))
        if self.owner:
            gone = changes.where("change = 'delete'").select(self.key, self.owner).distinct()
            owners = changes.where("change = 'cascade'").select(self.owner).distinct()
            kept = table.join(gone, [self.key, self.owner], "left_anti").join(owners, self.owner, "left_anti").select(*table.columns)
        else:
            kept = table
        fields = [c for c in changes.columns if c in self.patchable or c == "updated_at"]
        latest = changes.where("change = 'patch'").groupBy(self.key).agg(
            *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(f"_new_{c}") for c in fields)
        )
        return salted_join(kept, latest, [self.key], [self.key], "left").select(
            *(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns)
        )

    def compact(self, spark: SparkSession) -> int:
        """Fold the changes into the next version; the old one and its changes stay until they are removed."""
        return writers.write_version(self.read(spark), self.path)
