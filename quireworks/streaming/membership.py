"""Which documents a sink holds: an index in buckets by hash, each bucket with a Bloom filter.

``<path>/ids/bucket=<b>`` holds (doc_id, content, run, batch) and ``<path>/filters/bucket=<b>`` bitmaps in
which each document sets ``HASHES`` bits. A lookup reads the filters of the buckets that its documents fall
into, and opens only the buckets whose filter knows all bits of one of them: what it costs follows the batch
and not the sink. Everything is appended, and an entry may be there twice, so a lost or repeated write does
no harm; :meth:`Membership.compact` puts the files of a bucket together.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HASHES = 4
BITMAP_BITS = 32_768  # of Spark's bitmap functions
_ENTRY = "doc_id BIGINT, content BIGINT, run STRING, batch BIGINT"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, folder = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


@dataclass(frozen=True)
class Membership:
    """An index below ``path``. Keep ``buckets`` and ``bitmaps`` as they were when it was begun.

    A bucket's filter holds some 3,000 documents for each bitmap with few false alarms; beyond that it
    lets more buckets be opened, never fewer.
    """

    path: str
    buckets: int = 1024
    bitmaps: int = 16

    def bucket_of(self, doc_id: str = "doc_id") -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.buckets)).cast("int")

    def _bits(self, keys: DataFrame) -> DataFrame:
        """(doc_id, bucket, bitmap, bit): the bits of each document."""
        seeds = F.explode(F.array(*(F.lit(i) for i in range(HASHES)))).alias("seed")
        at = F.pmod(F.xxhash64("seed", "doc_id"), F.lit(self.bitmaps * BITMAP_BITS))
        spread = keys.select("doc_id", self.bucket_of().alias("bucket"), seeds).withColumn("at", at)
        return spread.select("doc_id", "bucket", F.expr(f"int(at div {BITMAP_BITS})").alias("bitmap"), F.expr(f"at % {BITMAP_BITS}").alias("bit"))

    def _read(self, spark: SparkSession, part: str, schema: str, buckets: Iterable[int]) -> DataFrame:
        """Rows of the given buckets; only their folders are listed."""
        there = set(children(spark, f"{self.path}/{part}"))
        folders = [f"{self.path}/{part}/bucket={b}" for b in sorted(buckets) if f"bucket={b}" in there]
        schema = f"{schema}, bucket INT"
        return spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*folders) if folders else spark.createDataFrame([], schema)

    def candidates(self, keys: DataFrame) -> list[int]:
        """Buckets that may hold one of ``keys`` (doc_id): at most all bucket numbers come to the driver."""
        spark = keys.sparkSession
        hit = [r["bucket"] for r in keys.select(self.bucket_of().alias("bucket")).distinct().collect()]
        filters = self._read(spark, "filters", "bitmap INT, bits BINARY", hit).groupBy("bucket", "bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))
        byte = F.conv(F.hex(F.expr("substring(bits, int(bit div 8) + 1, 1)")), 16, 10).cast("int")
        known = F.coalesce(F.expr("1 << int(bit % 8)").bitwiseAND(byte) != 0, F.lit(False))
        asked = self._bits(keys).join(filters, ["bucket", "bitmap"], "left")
        found = asked.groupBy("doc_id", "bucket").agg(F.bool_and(known).alias("all")).where("all")
        return sorted(r["bucket"] for r in found.select("bucket").distinct().collect())

    def entries_for(self, keys: DataFrame) -> DataFrame:
        """(doc_id, content, run, batch) of all buckets that may hold one of ``keys``."""
        found = self._read(keys.sparkSession, "ids", _ENTRY, self.candidates(keys))
        return found.select("doc_id", "content", "run", "batch")

    def add(self, entries: DataFrame) -> None:
        """Add ``entries`` (doc_id, content, run, batch); read twice, so better a written table."""
        keyed = entries.select("doc_id", "content", "run", "batch", self.bucket_of().alias("bucket"))
        self._append("ids", keyed)
        bitmaps = self._bits(entries).groupBy("bucket", "bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))
        self._append("filters", bitmaps)

    def _append(self, part: str, rows: DataFrame) -> None:
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{part}")

    def compact(self, spark: SparkSession, most_files: int = 16) -> list[int]:
        """Rewrite buckets of more than ``most_files`` files as one file each; returns their numbers.

        The new file is written before the old ones go: readers meanwhile see entries twice, which is no harm.
        """
        done: set[int] = set()
        for part, schema in (("ids", _ENTRY), ("filters", "bitmap INT, bits BINARY")):
            files = {}
            for name in children(spark, f"{self.path}/{part}"):
                if name.startswith("bucket="):
                    inside = [f for f in children(spark, f"{self.path}/{part}/{name}") if f.startswith("part-")]
                    if len(inside) > most_files:
                        files[int(name.split("=")[1])] = inside
            if not files:
                continue
            rows = self._read(spark, part, schema, files)
            self._append(part, rows.distinct() if part == "ids" else rows.groupBy("bucket", "bitmap").agg(F.bitmap_or_agg("bits").alias("bits")))
            for bucket, names in files.items():
                for name in names:
                    fs, old = _file_system(spark, f"{self.path}/{part}/bucket={bucket}/{name}")
                    fs.delete(old, False)
            done |= set(files)
        return sorted(done)
