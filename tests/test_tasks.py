"""Tasks stay small however many rows there are, and shared steps are worked out once."""

import glob

from pyspark.sql import functions as F
from settings import SF_DIR

from quireworks.checks import layout_queries, planted
from quireworks.functions.skew import buckets_for, tasks_for
from quireworks.operators import entities, keywords, layout, summarize
from quireworks.operators.postings import Postings
from quireworks.staging import application_dir, fresh_path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folders(spark, name):
    return set(glob.glob(f"{application_dir(spark).removeprefix('file://')}/{name}-*"))


def copies(spark, n=200):
    text = "The same text of some length is stored again. It has a second sentence in it too. And there is a third one here."
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit("all").alias("section"), F.lit(0).alias("section_order"), F.lit(text).alias("text"))


def test_number_of_tasks_follows_the_length(spark):
    at_least = spark.sparkContext.defaultParallelism
    texts = copies(spark)
    length = len(texts.first()["text"])
    assert tasks_for(texts, chars=length) == 200
    assert tasks_for(texts) == tasks_for(texts.where("doc_id < 0")) == at_least


def test_texts_are_taken_apart_in_a_set_number_of_tasks(spark):
    """Adaptive execution does not merge them into fewer and larger ones."""
    texts = copies(spark)
    for df in (summarize.score_sentences(texts), summarize.summarize_sections(texts), keywords.top_keywords(texts, ["doc_id"], 5)):
        assert "REPARTITION_BY_NUM" in plan_of(df) and "REPARTITION_BY_COL" not in plan_of(df)
        assert len({r["doc_id"] for r in df.collect()}) == 200
    before = folders(spark, "documents")
    assert layout_queries.overall_summary(spark, SF_DIR).count() > 0
    assert len(folders(spark, "documents") - before) == 1  # their length is known before they are spread


def test_page_rows_are_worked_out_once(spark):
    before = folders(spark, "page-rows")
    blocks = layout.blocks_with_sections(planted.planted_spans(spark, SF_DIR))
    assert len(folders(spark, "page-rows") - before) == 1
    assert blocks.where("section IS NULL").count() == 0


def test_letters_are_looked_up_only_where_there_are_any(spark):
    docs = spark.createDataFrame([(1, "We use İmageNet and PyTorch"), (2, "We use ImageNet and Pytorch"), (3, None)], "doc_id int, text string")
    found = entities.rank(docs)
    assert "RLIKE" in plan_of(found)
    names = {(r["doc_id"], r["entity"]) for r in found.collect()}
    assert {(1, "PyTorch"), (2, "ImageNet"), (2, "Pytorch")} <= names


def test_spans_are_delivered_in_as_many_files_as_their_length_asks_for(spark):
    before = folders(spark, "landing")
    taken = layout_queries.stream_ingest(spark, SF_DIR)
    assert taken.select("doc_id", "section").distinct().count() == taken.count() > 0
    (landing,) = folders(spark, "landing") - before
    assert len(glob.glob(f"{landing}/*.parquet")) == 2 * max(4, spark.sparkContext.defaultParallelism)


def test_papers_are_spread_before_their_words_are_weighed(spark):
    papers = spark.createDataFrame([(1, "Red widget red", ["economy"]), (2, "blue", ["red"]), (3, None, None), (None, "red", None)], "id int, title string, authors array<string>")
    before = folders(spark, "weighed-words")
    found = Postings(fresh_path(spark, "postings")).build(papers).search(spark, ["red", "economy"])
    assert [(r["id"], r["score"]) for r in found.where("id IS NOT NULL").collect()] == [(1, 2.4), (2, 0.4)]
    assert len(folders(spark, "weighed-words") - before) == 1


def test_number_of_buckets_follows_the_length(spark):
    texts = copies(spark)
    length = len(texts.first()["text"])
    assert buckets_for(texts, chars=length) == 200
    assert buckets_for(texts, chars=1) == 200 * length  # no more than there are characters
    assert buckets_for(texts.where("doc_id < 0")) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pages_are_dealt_by_their_length_not_by_the_session(spark):
    spans = planted.planted_spans(spark, SF_DIR)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        buckets = []
        for tasks in (23, None):
            known = folders(spark, "blocks")
            blocks = layout.blocks_with_sections(spans, tasks=tasks)
            (written,) = folders(spark, "blocks") - known
            buckets.append(len(glob.glob(f"{written}/*.parquet")))
            assert "SelectedBucketsCount: " in plan_of(blocks)  # few page rows do not make the blocks move
        assert buckets == [23, 2]  # a file each; the tables are small
        docs = layout.document_sections(blocks)
        assert "REPARTITION_BY_NUM" in plan_of(docs) and "REPARTITION_BY_COL" not in plan_of(docs)
        found = docs.select("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == len(set(found)) == spans.select("doc_id").distinct().count()


def test_a_scan_over_many_pages_is_spread(spark, monkeypatch):
    monkeypatch.setattr(layout, "TASK_PAGES", 10)
    pages = spark.range(100).selectExpr("id % 7 AS doc_id", "cast(id AS int) AS page", "1L AS n_blocks", "if(id % 5 = 0, 'results', NULL) AS closing")
    carried = layout.page_carry(pages)
    assert "doc_id#" in plan_of(carried) and ", 10), REPARTITION_BY_NUM" in plan_of(carried)
    rows = {(r["doc_id"], r["page"]): r for r in carried.collect()}
    assert len(rows) == 100 and rows[0, 7]["page_offset"] == 1 and rows[0, 7]["open_section"] == "results"
    assert rows[1, 1]["page_offset"] == 0 and rows[1, 1]["open_section"] == "introduction"
