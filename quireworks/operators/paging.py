"""Pages at any depth from a rank index: a table kept sorted, in ranges whose numbers of rows are known.

Offset paging over a plain table gathers everything before the page. Here the table is sorted once into
ranges (one folder and one file each) and the ranges are counted; a page at any offset reads the ranges it
lies in, usually one, and so does the page after a given row (keyset paging). An index shows the table as
it was when it was built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.operators.library import SORTABLE, sort_order

_PLACE_BITS = 33  # of a row's number within its partition


@dataclass(frozen=True)
class RankIndex:
    """An index below ``path`` in the order of :func:`library.sort_order`."""

    path: str
    sort_by: str
    descending: bool = True
    tie_break: str = "id"

    def build(self, df: DataFrame, ranges: int | None = None, allowed: tuple[str, ...] = SORTABLE) -> RankIndex:
        """Sort ``df`` into ``ranges`` (the session's shuffle partitions by default) and count them.

        Range borders come from Spark's sample of the sort columns. Ties are broken by ``tie_break``, so
        a value that many rows share fills several ranges.
        """
        spark = df.sparkSession
        order = sort_order(self.sort_by, self.descending, self.tie_break, allowed)
        ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumns(
            {"range_no": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << _PLACE_BITS) - 1)}
        )
        placed.write.partitionBy("range_no").parquet(f"{self.path}/rows")
        last = F.max_by(F.struct(F.col(self.sort_by).alias("last_value"), F.col(self.tie_break).alias("last_tie")), "place").alias("last")
        rows = self._rows(spark)
        counts = rows.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"), last) if rows else None
        if counts is not None:
            counts.select("range_no", "n", "last.*").write.parquet(f"{self.path}/counts")
        return self

    def _rows(self, spark: SparkSession) -> DataFrame | None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = any(s.getPath().getName().startswith("range_no=") for s in fs.listStatus(hadoop))
        return spark.read.parquet(f"{self.path}/rows") if there else None

    def _ranges(self, spark: SparkSession) -> list:
        """The counts in order: one small row for each range."""
        return spark.read.parquet(f"{self.path}/counts").orderBy("range_no").collect()

    def total(self, spark: SparkSession) -> int:
        """The number of rows, from the counts."""
        return sum(r["n"] for r in self._ranges(spark)) if self._rows(spark) is not None else 0

    def _shown(self, rows: DataFrame) -> DataFrame:
        order = sort_order(self.sort_by, self.descending, self.tie_break, (self.sort_by,))
        return rows.orderBy(*order).drop("range_no", "place")

    def page(self, spark: SparkSession, page: int = 1, per_page: int = 10) -> DataFrame | None:
        """One page with ``total`` and ``total_pages`` on each row, as :func:`library.page_of`; None for an empty table."""
        if page < 1 or per_page < 1:
            raise ValueError("page and per_page start at 1")
        rows = self._rows(spark)
        if rows is None:
            return None
        ranges, first, at, inside = self._ranges(spark), (page - 1) * per_page, 0, F.lit(False)
        for r in ranges:
            low, high = max(first - at, 0), min(first + per_page - at, r["n"])
            if low < high:
                inside = inside | ((F.col("range_no") == r["range_no"]) & F.col("place").between(low, high - 1))
            at += r["n"]
        shown = self._shown(rows.where(inside))
        return shown.withColumns({"total": F.lit(at).cast("bigint"), "total_pages": F.lit(-(-at // per_page)).cast("bigint")})

    def _after(self, value: Column, tie: Column, last_value: object, last_tie: object) -> Column:
        """Whether (value, tie) comes after the given row; nulls are first when descending, else last."""
        same_null = value.isNull() & (tie > F.lit(last_tie))
        if last_value is None:
            return (same_null | value.isNotNull()) if self.descending else same_null
        beyond = value < F.lit(last_value) if self.descending else value > F.lit(last_value)
        later = beyond | ((value == F.lit(last_value)) & (tie > F.lit(last_tie)))
        return F.coalesce(later, F.lit(False)) if self.descending else F.coalesce(later, F.lit(False)) | value.isNull()

    def after(self, spark: SparkSession, last_value: object, last_tie: object, per_page: int = 10) -> DataFrame | None:
        """The rows after the one with these values: what the last row of a page hands to the next."""
        rows = self._rows(spark)
        if rows is None:
            return None
        later = self._after(F.col("last_value"), F.col("last_tie"), last_value, last_tie)
        ranges = spark.read.parquet(f"{self.path}/counts").where(later).orderBy("range_no").collect()
        wanted, sure = [], 0
        for i, r in enumerate(ranges):
            if sure >= per_page:
                break
            wanted.append(r["range_no"])
            sure += r["n"] if i else 0  # the row may lie anywhere in the first of them
        here = rows.where(F.col("range_no").isin(wanted)) if wanted else rows.where(F.lit(False))
        return self._shown(here.where(self._after(F.col(self.sort_by), F.col(self.tie_break), last_value, last_tie))).limit(per_page)
