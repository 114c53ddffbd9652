import datetime as dt

import pytest
from pyspark.sql import functions as F

from quireworks.operators import library, maintenance
from quireworks.plans import dashboard

SUMMARIES = "id string, user_id string, processing_time_seconds decimal(10,2), word_count int, created_at timestamp"
ACTIVITY = "id int, user_id string, activity_type string, created_at timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def users(spark):
    return spark.createDataFrame([("u1", "a@x"), ("u2", "b@x")], "id string, email string")


def test_stats_cover_users_without_summaries(spark):
    from decimal import Decimal

    rows = [("s1", "u1", Decimal("1.00"), 10, at(1)), ("s2", "u1", Decimal("2.00"), 20, at(1, 5)), ("s3", "gone", None, 1, at(2))]
    stats = library.user_summary_stats(users(spark), spark.createDataFrame(rows, SUMMARIES))
    found = {r.user_id: r for r in stats.collect()}
    assert (found["u1"].total_summaries, float(found["u1"].avg_processing_time), found["u1"].total_words_processed, found["u1"].active_days) == (2, 1.5, 30, 1)
    assert (found["u2"].total_summaries, found["u2"].avg_processing_time, found["u2"].total_words_processed, found["u2"].active_days) == (0, None, None, 0)
    assert set(found) == {"u1", "u2"}
    shown = {r.user_id: r for r in library.with_dashboard_defaults(stats).collect()}
    assert (shown["u2"].avg_processing_time, shown["u2"].total_words_processed) == (0.0, 0)


def test_latest_and_distribution(spark):
    rows = [(i, "u1", None if i % 2 else "view", at(1 + i)) for i in range(12)] + [(99, "u2", "", at(1))]
    df = spark.createDataFrame(rows, ACTIVITY)
    assert sorted(r.id for r in library.latest_per_user(df).where("user_id = 'u1'").collect()) == list(range(2, 12))
    counts = {(r.user_id, r.activity_type): r.n for r in library.activity_distribution(df).collect()}
    assert counts == {("u1", "view"): 5, ("u1", "other"): 5, ("u2", "other"): 1}


def test_dashboard_is_complete(spark):
    rows = [("s1", "u1", None, 3, at(1)), ("s2", "u1", None, 4, at(31))]
    board = dashboard.dashboards(
        users(spark), spark.createDataFrame(rows, SUMMARIES), spark.createDataFrame([(1, "u1", "view", at(1))], ACTIVITY),
        F.lit("2024-02-01").cast("timestamp"),
    )
    found = {r.user_id: r for r in board.collect()}
    assert found["u1"].monthly_summaries == {"2024-01": 2} and len(found["u1"].recent_activity) == 1
    assert found["u2"].monthly_summaries == {} and found["u2"].recent_activity == []


PAPERS = [
    (1, "2401.1", "Deep Graphs", ["Ann Lee", "Bo"], "We study graphs", "cs.LG", "2024-01-02"),
    (2, "2401.2", "100% Safe", ["Cy"], "Nothing deep", "cs.CV", "2024-01-03"),
    (3, "2401.3", "Other", ["Deepak"], None, "cs.LG", None),
]
PAPER_SCHEMA = "id int, arxiv_id string, title string, authors array<string>, summary string, primary_category string, published string"


@pytest.mark.parametrize(
    "field, phrase, ids",
    [
        ("title", "deep", {1}),
        ("author", "DEEP", {3}),
        ("abstract", "deep", {2}),
        ("all", "deep", {1, 2, 3}),
        ("category", "cs.CV", {2}),
        ("title", "0%", {2}),
        ("title", "  ", {1, 3}),
    ],
)
def test_paper_filter(spark, field, phrase, ids):
    df = spark.createDataFrame(PAPERS, PAPER_SCHEMA)
    assert {r.id for r in df.where(library.paper_filter(field, phrase)).collect()} == ids


def test_search_is_newest_first_and_capped(spark):
    df = spark.createDataFrame(PAPERS, PAPER_SCHEMA)
    assert [r.id for r in library.search_papers(df, library.paper_filter("all", "deep")).collect()] == [2, 1, 3]
    assert [r.id for r in library.search_papers(df, library.paper_filter("all", "deep"), 1).collect()] == [2]
    with pytest.raises(ValueError):
        library.paper_filter("year", "x")


def test_pages_and_null_order(spark):
    df = spark.createDataFrame([(i, None if i == 3 else i) for i in range(7)], "id int, word_count int")
    page = library.page_of(df, library.sort_order("word_count"), page=1, per_page=3).collect()
    assert [r.id for r in page] == [3, 6, 5] and {(r.total, r.total_pages) for r in page} == {(7, 3)}
    up = library.page_of(df, library.sort_order("word_count", descending=False), page=3, per_page=3).collect()
    assert [r.id for r in up] == [3]
    assert library.page_summary(df, 9, 3) == {"total": 7, "page": 9, "per_page": 3, "total_pages": 3}
    with pytest.raises(ValueError):
        library.sort_order("password_hash")
    with pytest.raises(ValueError):
        library.page_of(df, [], page=0)


def test_any_contains(spark):
    df = spark.createDataFrame([("A_b", None), (None, "a1b"), ("zz", "zz")], "x string, y string")
    assert df.where(library.any_contains(["x", "y"], "a_B")).count() == 1
    assert df.where(library.any_contains(["x", "y"], "")).count() == 3


def test_weighted_search(spark):
    df = spark.createDataFrame(PAPERS, PAPER_SCHEMA)
    rows = library.weighted_search(df, ["Deep", "ann", "deepak"]).collect()
    assert [(r.id, r.score) for r in rows] == [(1, 1.4), (3, 0.4)]


@pytest.mark.parametrize("by, ids", [("newest", [2, 1, 3]), ("oldest", [1, 2, 3]), ("relevance", [1, 2, 3])])
def test_sort_results(spark, by, ids):
    df = spark.createDataFrame(PAPERS, PAPER_SCHEMA).withColumn("relevance_rank", F.col("id"))
    assert [r.id for r in library.sort_results(df, by).collect()] == ids


def test_patch_only_changes_what_it_names(spark):
    schema = "id int, full_name string, bio string, updated_at timestamp"
    base = spark.createDataFrame([(1, "a", "x", at(1)), (2, "b", None, at(1))], schema)
    patches = spark.createDataFrame([(1, " new ", None, "hacked"), (2, None, None, "h"), (9, "n", "b", "h")], "id int, full_name string, bio string, email string")
    rows = maintenance.patch(base, patches, F.lit("2024-02-02").cast("timestamp")).orderBy("id").collect()
    assert [(r.full_name, r.bio, r.updated_at) for r in rows] == [("new", "x", dt.datetime(2024, 2, 2)), ("b", None, at(1))]
    with pytest.raises(ValueError):
        maintenance.patch(base, patches.select("id", "email"), F.current_timestamp())
    twice = spark.createDataFrame([(1, "late", 2), (1, "zzz", 1), (2, "only", 1)], "id int, full_name string, n int")
    rows = maintenance.patch(base, twice, F.lit("2024-02-02").cast("timestamp"), order="n").orderBy("id").collect()
    assert [r.full_name for r in rows] == ["late", "only"]


def test_deletes(spark):
    table = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u1")], "id int, user_id string")
    requests = spark.createDataFrame([(1, "u1"), (2, "u1"), (7, "u1")], "id int, user_id string")
    assert sorted(r.id for r in maintenance.owner_delete(table, requests).collect()) == [2, 3]
    gone = spark.createDataFrame([("u1",)], "user_id string")
    assert [r.id for r in maintenance.cascade_delete(table, gone).collect()] == [2]


def test_new_rows_get_defaults(spark):
    new = spark.createDataFrame(
        [(None, "u1", None, None, None, None, 1.005, None)],
        "id string, user_id string, paper_title string, paper_authors array<string>, paper_url string, arxiv_id string, "
        "processing_time_seconds double, word_count int",
    ).withColumns({"summary_data": F.struct(F.lit("s").alias("overall_summary")), "model_used": F.lit(None).cast("string")})
    row = maintenance.summary_rows(new, F.lit("2024-01-01").cast("timestamp")).first()
    assert (row.paper_title, row.paper_authors, row.model_used, str(row.processing_time_seconds), row.word_count) == ("", [], "LED", "1.01", 0)
    assert len(row.id) == 36


def test_upload_validation(spark):
    rows = [("/a/x.pdf", 10), ("/a/X.PDF", 50 * 1024 * 1024), ("/a/y.pdf", 50 * 1024 * 1024 + 1), ("/a/z.txt", 1), ("/a/pdf", 1), ("/a/", 1), (None, 1)]
    found = maintenance.validate_uploads(spark.createDataFrame(rows, "path string, length bigint")).collect()
    assert [r.reject_reason for r in found] == [
        None, None, "file too large", "file type not allowed", "file type not allowed", "no file selected", "no file selected"
    ]


def test_batch_isolates_failures(spark):
    items = spark.createDataFrame([(1, "/a"), (2, None), (3, "/b")], "item int, path string")
    existing = spark.createDataFrame([("/a",), ("/a",)], "path string")
    marked = maintenance.split_batch(items, existing)
    assert {r.item: (r.success, r.error) for r in marked.collect()} == {
        1: (True, None), 2: (None, "Invalid PDF path"), 3: (None, "Invalid PDF path")
    }
    assert tuple(maintenance.batch_outcome(marked).first()) == (3, 1, 2)


def test_key_checks(spark):
    child = spark.createDataFrame([(1, "u1"), (2, "u9")], "id int, user_id string")
    assert [r.id for r in maintenance.orphans(child, users(spark)).collect()] == [2]
    assert maintenance.duplicate_keys(child.unionAll(child.where("id = 1")), "id").first()["id"] == 1
