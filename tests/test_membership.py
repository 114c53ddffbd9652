import re
from pathlib import Path

from pyspark.sql import functions as F
from test_layout import spans_of
from test_sources_streams import docs

from quireworks import staging
from quireworks.staging import scratch, stage
from quireworks.streaming import ingest
from quireworks.streaming.membership import Membership


def entries(spark, first, last, batch=0):
    return spark.range(first, last).select(
        F.col("id").alias("doc_id"), (F.col("id") * 3).alias("content"), F.lit("r").alias("run"), F.lit(batch).cast("bigint").alias("batch")
    )


def test_a_small_batch_opens_few_buckets_of_a_large_sink(spark, tmp_path):
    index = Membership(str(tmp_path / "index"), buckets=64)
    index.add(entries(spark, 0, 10_000))
    half_new = spark.range(9_995, 10_005).toDF("doc_id")
    found = index.entries_for(half_new)
    opened = {re.search(r"bucket=(\d+)", f)[1] for f in found.inputFiles()}
    assert 1 <= len(opened) <= 10
    known = found.join(half_new, "doc_id", "left_semi").collect()
    assert {(r["doc_id"], r["content"]) for r in known} == {(i, 3 * i) for i in range(9_995, 10_000)}
    # documents that it does not hold hardly open anything
    assert len(index.candidates(spark.range(20_000, 20_040).toDF("doc_id"))) <= 3
    assert index.candidates(spark.range(0).toDF("doc_id")) == []


def test_every_document_is_found(spark, tmp_path):
    index = Membership(str(tmp_path / "index"), buckets=7, bitmaps=1)
    for batch in range(5):
        index.add(entries(spark, batch * 400, batch * 400 + 400, batch))
    index.add(entries(spark, 0, 400, 0))  # a repeated write
    keys = spark.range(0, 2_000, 3).toDF("doc_id")
    before = {tuple(r) for r in index.entries_for(keys).collect()}
    assert {r[0] for r in before} >= set(range(0, 2_000, 3))
    assert index.compact(spark, most_files=3) == list(range(7))
    files = [len(list((tmp_path / "index" / part / f"bucket={b}").glob("part-*"))) for part in ("ids", "filters") for b in range(7)]
    assert set(files) == {1}
    assert {tuple(r) for r in index.entries_for(keys).collect()} == before
    assert index.compact(spark, most_files=3) == []
    assert Membership(str(tmp_path / "none")).entries_for(keys).count() == 0


def test_what_is_staged_in_a_scratch_goes(spark):
    folder = Path(staging.application_dir(spark).removeprefix("file:"))
    try:
        with scratch(spark):
            assert stage(spark.range(3), "gone").count() == 3
            raise KeyError
    except KeyError:
        pass
    assert not list(folder.glob("gone-*"))
    assert stage(spark.range(3), "kept").count() == 3 and list(folder.glob("kept-*"))


def test_the_stream_leaves_no_copies_and_an_index_that_can_be_made_again(spark, tmp_path):
    land, sink = str(tmp_path / "land"), str(tmp_path / "sink")
    spans = spans_of(spark, docs())
    folder = Path(staging.application_dir(spark).removeprefix("file:"))
    before = set(folder.glob("batch*"))

    def run(name):
        ingest.ingest(ingest.read_span_stream(spark, land), sink, str(tmp_path / name)).awaitTermination()
        return sorted(r["doc_id"] for r in spark.read.parquet(sink).collect())

    spans.where("doc_id = 1").coalesce(1).write.mode("append").parquet(land)
    assert run("state") == [1]
    assert set(folder.glob("batch*")) == before
    # the index is lost: the next stream makes it again and still knows the document
    other = Membership(str(tmp_path / "index-2"))
    assert len(ingest.catch_up(spark, sink, other)) == 1 and ingest.catch_up(spark, sink, other) == []
    spans.coalesce(1).write.mode("append").parquet(land)
    ingest.ingest(ingest.read_span_stream(spark, land), sink, str(tmp_path / "state-2"), index=other).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(sink).collect()) == [1, 2]
