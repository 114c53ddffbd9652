"""URL rules as a sort-merge range join.

The labels of a host are reversed (``blog.example.net`` -> ``net.example.blog.``), so a rule's host
and all its subdomains are one interval of the sorted keys, and the intervals of different rules
are nested or apart. Pages and rules are range-partitioned by that key together and each partition
is swept once with a stack of the rules whose interval is open; a page takes the longest rule on the
stack whose path its own path starts with. A rule that is open where a partition begins belongs to
an ancestor of the partition's first host, so it is found by an equality join of one row per
partition. Nothing is broadcast, and pages of one host are split by page_id.

Cases: a null url or one without ``://`` has an empty host and path and fits no rule; repeated pages
are judged each; an empty table gives an empty result; other columns are ignored. A rule with an
empty or null host fits nothing, a null path is empty. Of rules with equal host and path, the
alphabetically first verdict holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import table
from quireworks.staging import stage

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_OUT = "page_id bigint, host string, path string, rule string, verdict string"
_NAMES = ["page_id", "host", "path", "rule", "verdict"]


def url_host(url: Column) -> Column:
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *_LETTERS)
    return F.coalesce(host, F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _ancestors(key: Column) -> Column:
    """``net.example.blog.`` -> ``net.``, ``net.example.``, ``net.example.blog.``"""
    labels = F.slice(F.split(key, r"\."), 1, F.size(F.split(key, r"\.")) - 1)
    return F.transform(labels, lambda _, i: F.concat(F.array_join(F.slice(labels, 1, i + 1), "."), F.lit(".")))


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    piece, stack = None, []
    for batch in batches:
        out = []
        read = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("piece", "key", "kind", "page_id", "host", "path", "verdict"))
        for at, key, kind, page_id, host, path, verdict in zip(*read):
            if at != piece:
                piece, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind < 2:
                if (key, host, path, verdict) not in stack:  # a carried rule may begin here too
                    stack.append((key, host, path, verdict))
                continue
            fits = [r for r in stack if path.startswith(r[2])]
            best = min(fits, key=lambda r: (-len(r[0]) - len(r[2]), -len(r[0]), r[3]), default=None)
            out.append((page_id, host, path, best and best[1] + best[2], best[3] if best else default))
        columns = zip(*out) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.string()] * 4])], _NAMES)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for ``pages`` (page_id, url) by ``rules`` (verdict, host, path).

    A rule is written host then path in ``rule``; the longest (host and path together) wins.
    """
    urls = pages.select(F.col("page_id").cast("bigint"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    shape = ["key", "kind", "page_id", "host", "path", "verdict"]
    rules = rules.where("host <> ''").select("verdict", F.translate("host", *_LETTERS).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    rules = rules.withColumns({"key": host_key(F.col("host")), "kind": F.lit(1), "page_id": F.lit(None).cast("bigint")}).select(shape)
    urls = urls.withColumns({"key": host_key(F.col("host")), "kind": F.lit(2), "verdict": F.lit(None).cast("string")}).select(shape)
    events = urls.unionByName(rules).repartitionByRange("key", "kind", "page_id")
    events = stage(events.withColumn("piece", F.spark_partition_id()), "url-events")
    first = events.groupBy("piece").agg(F.min("key").alias("first")).select("piece", F.explode(_ancestors(F.col("first"))).alias("key"))
    carried = rules.join(first, "key").withColumn("kind", F.lit(0))
    swept = events.unionByName(carried).repartition("piece").sortWithinPartitions("piece", "key", "kind", "page_id")
    return swept.mapInArrow(lambda batches: _sweep(batches, default), _OUT)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


SQL = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), urls AS (
    SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), rules(verdict, rhost, rpath) AS (
    VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
)
SELECT page_id, host, path,
    (SELECT rhost || rpath FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
     ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
    coalesce((SELECT verdict FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
     ORDER BY length(rhost || rpath) DESC LIMIT 1), 'allow') AS verdict
FROM urls
"""
