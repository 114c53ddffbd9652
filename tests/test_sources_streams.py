import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_layout import LONG, simple, spans_of

from quireworks import staging
from quireworks.operators import layout
from quireworks.plans import record
from quireworks.sources import readers, schemas, writers
from quireworks.streaming import activity, ingest


def test_saved_summaries(spark, tmp_path):
    record_ = {"title": "T", "authors": ["a", "b", "c", "d"], "arxiv_id": "1", "published": "2024", "sections_found": ["x", "y"], "extra": 1}
    (tmp_path / "summary_ab-1.json").write_text(json.dumps(record_, indent=2))
    (tmp_path / "summary_2.json").write_text(json.dumps({"title": "U"}))
    (tmp_path / "other.json").write_text("{}")
    rows = {r.summary_id: r for r in readers.list_summaries(readers.read_saved_summaries(spark, str(tmp_path))).collect()}
    assert set(rows) == {"ab-1", "2"}
    assert rows["ab-1"].authors == ["a", "b", "c"] and rows["ab-1"].sections == 2
    assert rows["2"].authors == [] and rows["2"].sections == 0 and rows["2"].arxiv_id is None


def test_read_papers(spark, tmp_path):
    papers = [
        {"title": "Old", "authors": ["a"], "arxiv_id": "1", "published": "2023-01-01", "primary_category": "cs.LG"},
        {"title": "New", "authors": ["b"], "arxiv_id": "2", "published": "2025-08-07 15:04:07+00:00", "primary_category": "cs.LG"},
        {"title": "Else", "authors": ["b"], "arxiv_id": "3", "published": "2025-08-07", "primary_category": "cs.CV"},
    ]
    (tmp_path / "papers.json").write_text("\n".join(json.dumps(p) for p in papers))
    assert [r.title for r in readers.read_papers(spark, str(tmp_path)).collect()] == ["New", "Old"]
    assert [r.title for r in readers.read_papers(spark, str(tmp_path), max_results=1).collect()] == ["New"]


def test_paper_defaults(spark):
    df = spark.createDataFrame([(None, None, None, None, None, "/up/My.Paper.pdf")], "title string, authors array<string>, arxiv_id string, published string, primary_category string, pdf_path string")
    row = readers.with_paper_defaults(df, F.lit("2024-05-06").cast("date")).first()
    assert tuple(row)[:5] == ("My.Paper", [], "uploaded", "2024-05-06", "Unknown")


def test_list_files_leaves_content_out(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1")
    rows = readers.list_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in rows] == [("a.pdf", 5)] and "content" not in rows[0].asDict()


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.write_version(spark.range(3), path) == 1
    assert writers.write_version(writers.read_version(spark, path).where("id > 0"), path) == 2
    assert writers.read_version(spark, path).count() == 2 and writers.read_version(spark, path, 1).count() == 3
    # a version without its success mark is not seen
    (tmp_path / "t" / "version=3").mkdir()
    assert writers.read_version(spark, path).count() == 2


def test_append_rows(spark, tmp_path):
    for _ in range(2):
        writers.append_rows(spark.range(2), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4


def test_markdown_styles(spark):
    df = spark.createDataFrame(
        [("T", ["a", "b"], "2024", "cs.LG", "S.", ["k1", "k2"], (["m"], ["d1", "d2"], []), [(0, "related_work", "R.", [])])],
        "title string, authors array<string>, published string, primary_category string, overall_summary string, overall_keywords array<string>, "
        "entities struct<models: array<string>, datasets: array<string>, metrics: array<string>>, "
        "section_list array<struct<section_order: int, section: string, summary: string, keywords: array<string>>>",
    )
    full = (
        "# T\n\n**Authors:** a, b\n\n**Published:** 2024\n\n**Category:** cs.LG\n\n## Summary\n\nS.\n\n## Keywords\n\nk1, k2\n\n"
        "## Entities\n\n- **Datasets:** d1, d2\n- **Models:** m\n- **Metrics:** \n\n## Section Summaries\n\n### Related_Work\n\nR.\n\n"
    )
    row = df.select(writers.markdown().alias("f"), writers.markdown("plain").alias("p"), writers.markdown("brief").alias("b")).first()
    assert row.f == full and row.p == full.replace("**Category:** cs.LG\n\n", "")
    assert row.b == "# T\n\n**Authors:** a, b\n\n## Summary\n\nS.\n\n## Keywords\n\nk1, k2\n\n"


def docs():
    return {
        1: simple(LONG, "#Proposed Method", *(f"Then we train the BERT network number {i} on the data." for i in range(12)), "#Results", LONG),
        2: simple("#References", LONG),
    }


def test_paper_records(spark):
    meta = spark.createDataFrame([(1, "A title"), (2, "B"), (3, "no text")], "doc_id bigint, title string")
    rows = {r.doc_id: r for r in record.export_form(record.records_from_spans(spans_of(spark, docs()), meta)).collect()}
    assert rows[1].sections_found == ["introduction", "methodology", "results"]
    assert rows[1].entities.models == ["BERT"] and rows[1].entities.techniques == []
    assert set(rows[1].section_summaries) == {"introduction", "methodology", "results"}
    assert rows[1].section_keywords["methodology"] and rows[1].section_keywords["results"] == []
    assert rows[1].methodology_flowchart.startswith("graph TD")
    assert rows[1].num_words_summary <= rows[1].num_words_original
    assert rows[2].sections_found == ["introduction"] and rows[2].methodology_flowchart is None
    assert rows[3].sections_found == ["introduction"] and rows[3].overall_summary == ""
    assert rows[3].num_words_original == 0 and rows[3].entities.models == [] and rows[3].section_summaries == {}


def test_stream_equals_batch_with_repeated_delivery(spark, tmp_path):
    spans = spans_of(spark, docs())
    land, sink = str(tmp_path / "land"), str(tmp_path / "sink")
    for doc_id in (1, 1, 2):
        spans.where(f"doc_id = {doc_id}").coalesce(1).write.mode("append").parquet(land)

    def run():
        stream = ingest.read_span_stream(spark, land, files_per_batch=1)
        ingest.ingest(stream, sink, str(tmp_path / "state")).awaitTermination()
        return {r.doc_id: r.sections for r in spark.read.parquet(sink).collect()}, spark.read.parquet(sink).count()

    batch = {r.doc_id: r.sections for r in layout.document_sections(layout.blocks_with_sections(spans)).collect()}
    assert run() == (batch, 2)
    spans.where("doc_id = 2").coalesce(1).write.mode("append").parquet(land)
    assert run() == (batch, 2)


def test_stream_keeps_all_pages_and_earlier_documents(spark, tmp_path):
    spans = spans_of(spark, docs())
    sink = str(tmp_path / "sink")

    def run(name, *parts):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"land-{name}"))
        stream = ingest.read_span_stream(spark, str(tmp_path / f"land-{name}"))
        ingest.ingest(stream, sink, str(tmp_path / f"state-{name}")).awaitTermination()
        refused = spark.read.parquet(f"{sink}-refused").select("doc_id", "reason").collect()
        return {r.doc_id: r.sections for r in spark.read.parquet(sink).collect()}, {tuple(r) for r in refused}

    whole = {r.doc_id: r.sections for r in layout.document_sections(layout.blocks_with_sections(spans)).collect()}
    first = spans.where("doc_id = 1")
    # one document over two files that overlap
    assert run("a", first.where("block_no < 3"), first.where("block_no >= 2")) == ({1: whole[1]}, set())
    # another stream on the same sink, with a known document once as it was and once changed
    assert run("b", spans.where("doc_id = 2"), first) == (whole, set())
    changed = first.withColumn("text", F.concat("text", F.lit("!")))
    assert run("c", changed) == (whole, {(1, "already taken in with other content")})
    other = spans.where("doc_id = 2").withColumn("doc_id", F.lit(9).cast("bigint"))
    found, refused = run("d", other, other.withColumn("size", F.col("size") + 1))
    assert found == whole and (9, "files of one document disagree") in refused


def test_window_counts_drop_late_rows(spark, tmp_path):
    land = str(tmp_path / "land")
    schema = "ts timestamp, event_type string"

    def deliver(*rows):
        spark.createDataFrame(list(rows), "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(land)

    def run():
        counts = activity.window_counts(spark.readStream.schema(schema).parquet(land))
        activity.write_counts(counts, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        rows = spark.read.schema("window_start timestamp, event_type string, n bigint").parquet(str(tmp_path / "out")).collect()
        return {(str(r.window_start.date()), r.event_type): r.n for r in rows}

    deliver(("2024-01-01 10:00:00", "view"), ("2024-01-01 23:00:00", "view"), ("2024-01-02 00:30:00", "view"))
    assert run() == {}
    deliver(("2024-01-01 23:30:00", "view"), ("2024-01-02 02:00:00", None))
    assert run() == {("2024-01-01", "view"): 3}
    deliver(("2024-01-01 12:00:00", "late"), ("2024-01-03 02:00:00", "view"))
    assert run() == {("2024-01-01", "view"): 3, ("2024-01-02", "view"): 1, ("2024-01-02", "other"): 1}


def test_spans_schema_reads_back(spark, tmp_path):
    spans_of(spark, docs()).write.parquet(str(tmp_path / "s"))
    assert readers.read_spans(spark, str(tmp_path / "s")).count() == 18
    for ddl in (schemas.USERS, schemas.SUMMARIES, schemas.ACTIVITY, schemas.SUMMARY_FILE, schemas.PAPERS):
        assert spark.createDataFrame([], ddl).count() == 0


class FakeConf:
    def get(self, key, default):
        return default


class FakeSession:
    conf = FakeConf()

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})


def test_staged_tables_can_be_discarded(spark):
    before = staging.stage(spark.range(5), "five")
    assert before.count() == 5
    folder = Path(staging.application_dir(spark).removeprefix("file:"))
    assert list(folder.glob("five-*/_SUCCESS"))
    assert staging.discard_staged(spark) and not folder.exists()


def test_shared_folder_is_required():
    with pytest.raises(ValueError):
        staging.shared_dir(FakeSession("yarn"))
    with pytest.raises(ValueError):
        staging.shared_dir(FakeSession("local[2]"))
