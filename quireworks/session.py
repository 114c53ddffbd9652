"""A session with the settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "quireworks", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with adaptive execution, UTC and skew handling switched on.

    On a cluster leave ``master`` unset so that spark-submit decides, and pass
    ``spark.sql.shuffle.partitions`` to suit the cluster: it is the starting
    number, and adaptive execution merges small partitions afterwards.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        settings.setdefault("spark.ui.enabled", "false")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
