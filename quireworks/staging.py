"""Written intermediate tables.

An intermediate that several branches read is written once to the folder the
cluster shares and read back. That cuts the lineage, survives the loss of
executors, and keeps Parquet column pruning for the readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths, and table names where there are any, of what is staged in the innermost open :func:`scratch`.
_HELD: ContextVar[list[tuple[str, str | None]] | None] = ContextVar("held", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder from ``spark.checkpoint.dir``, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """Folder for everything this application stages."""
    return f"{shared_dir(spark)}/quireworks/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard_staged(spark: SparkSession) -> bool:
    """Delete what this application staged. Call it when the results are written."""
    return _delete(spark, application_dir(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end, also after an error: results must be written by then."""
    held: list[tuple[str, str | None]] = []
    token = _HELD.set(held)
    try:
        yield
    finally:
        _HELD.reset(token)
        for path, table in held:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            _delete(spark, path)


def _taken(spark: SparkSession, name: str, table: str | None = None) -> str:
    path = fresh_path(spark, name)
    if (held := _HELD.get()) is not None:
        held.append((path, table))
    return path


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table; with ``keep`` it outlives a :func:`scratch`."""
    spark = df.sparkSession
    path = fresh_path(spark, name) if keep else _taken(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, *keys: str, buckets: int | None = None) -> DataFrame:
    """Like :func:`stage`, but the written table keeps its partitioning by ``keys``.

    ``df`` is spread by ``keys`` over ``buckets`` partitions, the session's shuffle partitions unless given, so
    each bucket is one file. Joins and groups by ``keys`` then move the other side only.
    """
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", _taken(spark, name, table)).bucketBy(buckets, *keys).saveAsTable(table)
    return spark.table(table)
