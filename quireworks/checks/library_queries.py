"""Library reads, joins, aggregates and table changes on the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireworks.checks import planted
from quireworks.checks.registry import ORACLES, query
from quireworks.checks.sql import build
from quireworks.functions import text as tx
from quireworks.operators import library, maintenance, rollup
from quireworks.operators.paging import RankIndex
from quireworks.operators.postings import Postings
from quireworks.plans import dashboard
from quireworks.sources.deltas import DeltaTable
from quireworks.sources.writers import append_rows
from quireworks.staging import fresh_path

# The moment that stands for "now" in checks.
AS_OF = "2001-08-01 00:00:00"


def _as_of(value: str = AS_OF):
    return F.lit(value).cast("timestamp")


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


@query(
    "user_summary_stats",
    build(
        """SELECT user_id, email, total_summaries, avg_processing_time, total_words_processed,
        strftime(last_summary_date, '%Y-%m-%d') AS last_summary_date, active_days FROM user_stats""",
        "user_stats",
    ),
)
def user_summary_stats(spark, sf_dir):
    stats = library.user_summary_stats(planted.users(spark, sf_dir), planted.summaries(spark, sf_dir))
    return stats.withColumn("avg_processing_time", F.col("avg_processing_time").cast("double")).withColumn(
        "last_summary_date", _day("last_summary_date")
    )


@query(
    "user_stats_defaults",
    build(
        """SELECT user_id, total_summaries, coalesce(avg_processing_time, 0.0::DOUBLE) AS avg_processing_time,
        coalesce(total_words_processed, 0) AS total_words_processed, active_days FROM user_stats""",
        "user_stats",
    ),
)
def user_stats_defaults(spark, sf_dir):
    stats = library.user_summary_stats(planted.users(spark, sf_dir), planted.summaries(spark, sf_dir))
    return library.with_dashboard_defaults(stats).drop("email", "last_summary_date")


@query(
    "monthly_counts",
    build(
        f"""SELECT user_id, strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM summaries
        WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY GROUP BY ALL""",
        "summaries",
    ),
)
def monthly_counts(spark, sf_dir):
    return library.monthly_counts(planted.orders_as_summaries(spark, sf_dir), _as_of())


@query(
    "month_labels",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%b %Y') AS label, count(*) AS n FROM orders GROUP BY ALL",
)
def month_labels(spark, sf_dir):
    at = F.col("created_at")
    return (
        planted.orders_as_summaries(spark, sf_dir)
        .groupBy(tx.month_key(at).alias("month"), tx.month_label(at).alias("label"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "last_180_days",
    build(
        f"SELECT id, user_id FROM summaries WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY", "summaries"
    ),
)
def last_180_days(spark, sf_dir):
    return library.since_days(planted.orders_as_summaries(spark, sf_dir), _as_of()).select("id", "user_id")


@query("recent_activity_topn", build("SELECT user_id, recency, id, activity_type FROM latest", "latest"))
def recent_activity_topn(spark, sf_dir):
    recent = library.latest_per_user(planted.activity(spark, sf_dir))
    return recent.select("user_id", F.col("recency").cast("bigint").alias("recency"), "id", "activity_type")


@query(
    "activity_distribution",
    build("SELECT user_id, coalesce(activity_type, 'other') AS activity_type, count(*) AS n FROM latest GROUP BY ALL", "latest"),
)
def activity_distribution(spark, sf_dir):
    return library.activity_distribution(planted.activity(spark, sf_dir))


@query(
    "dashboard",
    build(
        f"""SELECT s.user_id, s.total_summaries, coalesce(s.avg_processing_time, 0.0::DOUBLE) AS avg_processing_time,
            coalesce(s.total_words_processed, 0) AS total_words_processed, s.active_days,
            coalesce(r.recent, '') AS recent, coalesce(m.months, '') AS months
        FROM user_stats s
        LEFT JOIN (SELECT user_id, string_agg(id || ':' || activity_type, ',' ORDER BY recency) AS recent FROM latest GROUP BY 1) r
            ON r.user_id = s.user_id
        LEFT JOIN (SELECT user_id, string_agg(month || '=' || n, ',' ORDER BY month) AS months FROM (
            SELECT user_id, strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM summaries
            WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY GROUP BY ALL) GROUP BY 1) m
            ON m.user_id = s.user_id""",
        "user_stats",
        "latest",
    ),
)
def dashboards(spark, sf_dir):
    boards = dashboard.dashboards(
        planted.users(spark, sf_dir), planted.summaries(spark, sf_dir), planted.activity(spark, sf_dir), _as_of()
    )
    recent = F.transform("recent_activity", lambda a: F.concat(a["id"].cast("string"), F.lit(":"), a["activity_type"]))
    months = F.transform(
        F.map_entries("monthly_summaries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return boards.select(
        "user_id", "total_summaries", "avg_processing_time", "total_words_processed", "active_days",
        F.array_join(recent, ",").alias("recent"), F.array_join(F.array_sort(months), ",").alias("months"),
    )


@query(
    "search_ilike_page",
    build(
        """SELECT id, paper_title, arxiv_id, strftime(created_at, '%Y-%m-%d') AS created, count(*) OVER () AS total,
            (count(*) OVER () + 9) // 10 AS total_pages FROM summaries
        WHERE paper_title ILIKE '%low%' OR arxiv_id ILIKE '%low%'
        ORDER BY created_at DESC NULLS FIRST, id LIMIT 10 OFFSET 20""",
        "summaries",
    ),
)
def search_ilike_page(spark, sf_dir):
    found = planted.orders_as_summaries(spark, sf_dir).where(library.any_contains(["paper_title", "arxiv_id"], "LOW"))
    rows = library.page_of(found, library.sort_order("created_at"), page=3)
    return rows.select("id", "paper_title", "arxiv_id", _day("created_at").alias("created"), "total", "total_pages")


_DEEP = """SELECT id, paper_title, strftime(created_at, '%Y-%m-%d') AS created FROM summaries
        WHERE paper_title ILIKE '%low%' OR arxiv_id ILIKE '%low%' ORDER BY created_at DESC NULLS FIRST, id"""


def _ranked_hits(spark, sf_dir):
    found = planted.orders_as_summaries(spark, sf_dir).where(library.any_contains(["paper_title", "arxiv_id"], "LOW"))
    return RankIndex(fresh_path(spark, "rank-index"), "created_at").build(found)


@query("search_deep_page", build(f"{_DEEP} LIMIT 10 OFFSET (SELECT (count(*) // 10) * 3 // 4 * 10 FROM ({_DEEP}))", "summaries"))
def search_deep_page(spark, sf_dir):
    """The page three quarters down the hits, from the one range of the index that holds it."""
    index = _ranked_hits(spark, sf_dir)
    total = index.total(spark)
    return index.page(spark, total // 10 * 3 // 4 + 1).select("id", "paper_title", _day("created_at").alias("created"))


@query("search_keyset_page", build(f"{_DEEP} LIMIT 10 OFFSET (SELECT (count(*) // 10) * 3 // 4 * 10 + 10 FROM ({_DEEP}))", "summaries"))
def search_keyset_page(spark, sf_dir):
    """The page after that one, found by its last row."""
    index = _ranked_hits(spark, sf_dir)
    last = index.page(spark, index.total(spark) // 10 * 3 // 4 + 1).collect()[-1]
    return index.after(spark, last["created_at"], last["id"]).select("id", "paper_title", _day("created_at").alias("created"))


@query(
    "search_ilike_all",
    build(
        "SELECT id, paper_title FROM summaries WHERE paper_title ILIKE '%gent%' OR arxiv_id ILIKE '%gent%'", "summaries"
    ),
)
def search_ilike_all(spark, sf_dir):
    found = planted.orders_as_summaries(spark, sf_dir).where(library.any_contains(["paper_title", "arxiv_id"], "gent"))
    return found.select("id", "paper_title")


@query(
    "sorted_page",
    build(
        """SELECT id, processing_time_seconds::DOUBLE AS seconds FROM summaries
        ORDER BY processing_time_seconds NULLS LAST, id LIMIT 25""",
        "summaries",
    ),
)
def sorted_page(spark, sf_dir):
    order = library.sort_order("processing_time_seconds", descending=False)
    rows = library.page_of(planted.orders_as_summaries(spark, sf_dir), order, page=1, per_page=25)
    return rows.select("id", F.col("processing_time_seconds").cast("double").alias("seconds"))


@query("paper_search_title", build("SELECT id, title FROM papers WHERE contains(lower(title), 'widget')", "papers"))
def paper_search_title(spark, sf_dir):
    return planted.papers(spark, sf_dir).where(library.paper_filter("title", "Widget")).select("id", "title")


@query(
    "paper_search_author",
    build("SELECT id, title FROM papers WHERE len(list_filter(authors, lambda a: contains(lower(a), 'red'))) > 0", "papers"),
)
def paper_search_author(spark, sf_dir):
    return planted.papers(spark, sf_dir).where(library.paper_filter("author", "red")).select("id", "title")


@query(
    "paper_search_all",
    build(
        """SELECT id, title FROM papers WHERE contains(lower(title), 'brand#1') OR contains(lower(summary), 'brand#1')
        OR len(list_filter(authors, lambda a: contains(lower(a), 'brand#1'))) > 0 OR primary_category = 'Brand#1'""",
        "papers",
    ),
)
def paper_search_all(spark, sf_dir):
    return planted.papers(spark, sf_dir).where(library.paper_filter("all", "Brand#1")).select("id", "title")


@query(
    "paper_search_text",
    "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'tion the')",
)
def paper_search_text(spark, sf_dir):
    docs = planted.documents(spark, sf_dir).withColumnRenamed("text", "summary")
    return docs.where(library.paper_filter("abstract", "tion the")).select("doc_id", "lang")


@query(
    "newest_papers",
    build(
        """SELECT id, title FROM papers WHERE primary_category = 'ECONOMY'
        ORDER BY published DESC NULLS LAST, id::VARCHAR LIMIT 20""",
        "papers",
    ),
)
def newest_papers(spark, sf_dir):
    hits = library.search_papers(planted.papers(spark, sf_dir), library.paper_filter("category", "ECONOMY"), 20)
    return hits.select("id", "title")


@query("sort_newest", build("SELECT id, title FROM papers ORDER BY published DESC, id", "papers"))
def sort_newest(spark, sf_dir):
    ranked = planted.papers(spark, sf_dir).withColumn("relevance_rank", F.col("id"))
    return library.sort_results(ranked, "newest").select("id", "title")


@query(
    "point_lookup",
    build("SELECT id, user_id, paper_title FROM summaries WHERE user_id = 7 AND id IN (SELECT max(id) FROM summaries WHERE user_id = 7)", "summaries"),
)
def point_lookup(spark, sf_dir):
    mine = library.scoped(planted.orders_as_summaries(spark, sf_dir), 7)
    wanted = mine.agg(F.max("id")).scalar()
    return mine.where(F.col("id") == wanted).select("id", "user_id", "paper_title")


@query("tenant_scope", build("SELECT id, activity_type FROM activity WHERE user_id = 8", "activity"))
def tenant_scope(spark, sf_dir):
    return library.scoped(planted.activity(spark, sf_dir), 8).select("id", "activity_type")


@query(
    "weighted_text_search",
    """SELECT p_partkey AS id, round(
        len(list_filter(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]{2,}'), lambda t: t IN ('red', 'widget'))) * 1.0::DOUBLE +
        len(list_filter(regexp_extract_all(lower(p_brand || ' ' || p_type), '[\\p{L}\\p{N}_]{2,}'), lambda t: t IN ('red', 'widget', 'economy'))) * 0.4::DOUBLE, 6) AS score
    FROM part WHERE regexp_matches(lower(p_name), '\\b(red|widget)\\b') OR regexp_matches(lower(p_type), '\\beconomy\\b')""",
)
def weighted_text_search(spark, sf_dir):
    papers = planted.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("authors")
    )
    return library.weighted_search(papers, ["red", "the", "Widget", "economy"]).select("id", "score")


@query("postings_search", ORACLES["weighted_text_search"])
def postings_search(spark, sf_dir):
    """The same search from a table of postings."""
    papers = planted.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("authors")
    )
    return Postings(fresh_path(spark, "postings")).build(papers).search(spark, ["red", "the", "Widget", "economy"])


@query("fetch_plan_anti", "SELECT c_custkey AS arxiv_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def fetch_plan_anti(spark, sf_dir):
    papers = planted.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "arxiv_id")
    existing = planted.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "arxiv_id")
    return maintenance.missing_from(papers, existing).select("arxiv_id", "c_name")


@query(
    "papers_with_files",
    "SELECT doc_id, lang, url FROM documents JOIN pages ON page_id = doc_id",
)
def papers_with_files(spark, sf_dir):
    files = planted.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return library.with_files(planted.documents(spark, sf_dir), files, "doc_id").select("doc_id", "lang", "url")


@query("attach_results", "SELECT doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def attach_results(spark, sf_dir):
    docs = planted.documents(spark, sf_dir).select("doc_id", "lang")
    return library.attach(docs, planted.table(spark, sf_dir, "labels")).select("doc_id", "lang", "quality")


# Deletion requests for all finished orders; only those of one priority come from the owner.
_REQUESTS = "SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey ELSE o_custkey + 1 END AS user_id FROM orders WHERE o_orderstatus = 'F'"


@query(
    "owner_delete",
    build(
        f"SELECT id, user_id FROM summaries WHERE id NOT IN (SELECT s.id FROM summaries s JOIN ({_REQUESTS}) r ON s.id = r.id AND s.user_id = r.user_id)",
        "summaries",
    ),
)
def owner_delete(spark, sf_dir):
    summaries = planted.orders_as_summaries(spark, sf_dir)
    owner = F.when(F.col("paper_title") == "1-URGENT", F.col("user_id")).otherwise(F.col("user_id") + 1)
    requests = summaries.where("arxiv_id = 'F'").select("id", owner.alias("user_id"))
    return maintenance.owner_delete(summaries, requests).select("id", "user_id")


@query(
    "cascade_delete",
    build("SELECT id, user_id FROM summaries WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", "summaries"),
)
def cascade_delete(spark, sf_dir):
    deleted = planted.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return maintenance.cascade_delete(planted.orders_as_summaries(spark, sf_dir), deleted).select("id", "user_id")


@query(
    "patch_update",
    build(
        """SELECT u.id, u.email, coalesce(s.s_name, u.full_name) AS full_name, u.bio,
            CASE WHEN s.s_name IS NULL THEN '2001-01-01' ELSE '2002-01-01' END AS updated
        FROM users u LEFT JOIN supplier s ON s.s_suppkey = u.id""",
        "users",
    ),
)
def patch_update(spark, sf_dir):
    base = planted.users(spark, sf_dir).withColumn("updated_at", _as_of("2001-01-01"))
    patches = planted.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("full_name"),
        F.lit(None).cast("string").alias("bio"),
        F.lit("ignored").alias("email"),
    )
    patched = maintenance.patch(base, patches, _as_of("2002-01-01"))
    return patched.select("id", "email", "full_name", "bio", _day("updated_at").alias("updated"))


@query(
    "append_summary_rows",
    """SELECT o_orderkey AS id, o_orderpriority AS paper_title, 'LED' AS model_used,
        ((round(o_totalprice * 100)::BIGINT + 50) // 100) / 100.0::DOUBLE AS seconds, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 5 END AS word_count FROM orders""",
)
def append_summary_rows(spark, sf_dir):
    new = planted.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("paper_title"),
        F.lit(None).cast("array<string>").alias("paper_authors"),
        F.lit(None).cast("string").alias("paper_url"),
        F.lit(None).cast("string").alias("arxiv_id"),
        F.struct(F.lit("").alias("overall_summary")).alias("summary_data"),
        F.lit(None).cast("string").alias("model_used"),
        (F.col("o_totalprice") / 100.0).alias("processing_time_seconds"),
        F.when(F.col("o_orderstatus") != "O", F.lit(5)).alias("word_count"),
    )
    # the key stays a number here so that both engines compare it as one
    rows = maintenance.summary_rows(new.withColumn("id", F.col("id").cast("string")), _as_of())
    return rows.select(
        F.col("id").cast("bigint").alias("id"), "paper_title", "model_used",
        F.col("processing_time_seconds").cast("double").alias("seconds"), "word_count",
    )


@query(
    "append_activity_rows",
    "SELECT o_custkey AS user_id, 'summarize' AS activity_type, o_orderkey AS summary_id, o_orderpriority AS paper_title, round(o_totalprice, 2) AS processing_time FROM orders",
)
def append_activity_rows(spark, sf_dir):
    rows = maintenance.activity_rows(planted.orders_as_summaries(spark, sf_dir))
    return rows.select("user_id", "activity_type", "activity_data.summary_id", "activity_data.paper_title", "activity_data.processing_time")


@query("json_payload_field", "SELECT event_id AS id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_payload_field(spark, sf_dir):
    payload = F.from_json("props", "k BIGINT")
    return planted.activity(spark, sf_dir).select("id", payload["k"].alias("k"))


_UPLOADS = """SELECT doc_id, CASE
        WHEN n_chars > 5000 THEN 'file too large' END AS big, CASE lang WHEN 'en' THEN '.PDF' WHEN 'de' THEN '.docx' ELSE '.pdf' END AS ext FROM documents"""


@query(
    "upload_validation",
    f"SELECT doc_id, CASE WHEN lower(ext) <> '.pdf' THEN 'file type not allowed' ELSE big END AS reject_reason FROM ({_UPLOADS})",
)
def upload_validation(spark, sf_dir):
    extension = F.when(F.col("lang") == "en", ".PDF").when(F.col("lang") == "de", ".docx").otherwise(".pdf")
    files = planted.documents(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("/papers/"), "doc_id", extension).alias("path"), F.col("n_chars").alias("length")
    )
    return maintenance.validate_uploads(files, max_bytes=5000).select("doc_id", "reject_reason")


def _batch(spark, sf_dir):
    name = F.concat(F.lit("/papers/"), F.col("doc_id"), F.lit(".pdf"))
    items = planted.documents(spark, sf_dir).select("doc_id", name.alias("path"))
    return maintenance.split_batch(items, planted.table(spark, sf_dir, "labels").select(name.alias("path")))


@query(
    "batch_items",
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN true END AS success, CASE WHEN l.doc_id IS NULL THEN 'Invalid PDF path' END AS error FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def batch_items(spark, sf_dir):
    return _batch(spark, sf_dir).select("doc_id", "success", "error")


@query(
    "batch_outcome",
    "SELECT count(*) AS total, count(l.doc_id) AS completed, count(*) - count(l.doc_id) AS failed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def batch_outcome(spark, sf_dir):
    return maintenance.batch_outcome(_batch(spark, sf_dir))


@query(
    "orphan_check",
    "SELECT o_orderkey AS id, o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)",
)
def orphan_check(spark, sf_dir):
    parents = planted.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return maintenance.orphans(planted.orders_as_summaries(spark, sf_dir), parents).select("id", "user_id")


@query(
    "duplicate_key_check",
    "SELECT c_name AS email, count(*) AS n FROM (SELECT c_name FROM customer UNION ALL SELECT c_name FROM customer WHERE c_acctbal > 0) GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_key_check(spark, sf_dir):
    users = planted.table(spark, sf_dir, "customer")
    twice = users.select("c_name").unionAll(users.where("c_acctbal > 0").select("c_name")).withColumnRenamed("c_name", "email")
    return maintenance.duplicate_keys(twice, "email")


_CHANGED = """SELECT o_orderkey AS id, o_custkey AS user_id,
        CASE WHEN o_orderkey % 5 = 0 THEN 'again' WHEN o_orderkey % 6 = 0 THEN o_orderstatus ELSE o_orderpriority END AS paper_title,
        CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 6 = 0 THEN '2001-08-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated
    FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderstatus = 'F') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""


def _changed(spark, sf_dir, compact):
    """Summaries with two patches, deletions by their owners (and by others, without effect) and the deletion of some users."""
    orders = planted.table(spark, sf_dir, "orders")
    table = DeltaTable(fresh_path(spark, "delta-table"), patchable=("paper_title",))
    table.create(planted.orders_as_summaries(spark, sf_dir).withColumn("updated_at", F.col("created_at")))
    key = F.col("o_orderkey").alias("id")
    title = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), "o_orderstatus"))  # others have no new value
    table.patch(orders.where("o_orderkey % 3 = 0").select(key, title.alias("paper_title")), _as_of())
    table.patch(orders.where("o_orderkey % 5 = 0").select(key, F.lit(" again ").alias("paper_title"), F.lit(-1).alias("user_id")), _as_of())
    asked = orders.where("o_orderkey % 7 = 0")
    owner = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(F.lit(-1).cast("bigint"))
    table.owner_delete(asked.select(key, owner.alias("user_id")))
    table.cascade_delete(planted.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id")))
    if compact:
        table.compact(spark)
    return table.read(spark).select("id", "user_id", "paper_title", _day("updated_at").alias("updated"))


@query("delta_changes", _CHANGED)
def delta_changes(spark, sf_dir):
    return _changed(spark, sf_dir, compact=False)


@query("delta_compacted", _CHANGED)
def delta_compacted(spark, sf_dir):
    return _changed(spark, sf_dir, compact=True)


def _appended_states(spark, sf_dir):
    """The states of summaries that came in two halves."""
    path, rows = fresh_path(spark, "user-days"), planted.summaries(spark, sf_dir)
    for half in ("id % 2 = 0", "id % 2 = 1"):
        append_rows(rollup.user_days(rows.where(half)), path)
    return spark.read.parquet(path)


@query("user_stats_from_states", ORACLES["user_summary_stats"])
def user_stats_from_states(spark, sf_dir):
    stats = rollup.user_stats(planted.users(spark, sf_dir), _appended_states(spark, sf_dir))
    return stats.withColumn("avg_processing_time", F.col("avg_processing_time").cast("double")).withColumn(
        "last_summary_date", _day("last_summary_date")
    )


@query("monthly_counts_from_states", ORACLES["monthly_counts"])
def monthly_counts_from_states(spark, sf_dir):
    return rollup.monthly_counts(rollup.merged(_appended_states(spark, sf_dir)), _as_of())
