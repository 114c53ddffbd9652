"""Sections from layout, lines and web pages; section summaries and full records; streams and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireworks.checks import planted
from quireworks.checks.registry import query
from quireworks.checks.sql import build, match_section, strip, tokens
from quireworks.functions import text as tx
from quireworks.functions.skew import tasks_for
from quireworks.operators import entities, keywords, layout, maintenance, summarize
from quireworks.plans import record
from quireworks.sources import readers, writers
from quireworks.staging import fresh_path, stage
from quireworks.streaming import activity, ingest


def _blocks(spark, sf_dir, mode="strict"):
    return layout.blocks_with_sections(planted.planted_spans(spark, sf_dir), mode)


def _sections(spark, sf_dir, mode="strict"):
    return layout.sections(planted.planted_spans(spark, sf_dir), mode)


def _long(df, *columns):
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


@query("span_median_threshold", build("SELECT doc_id, median_size, header_size FROM medians", "medians"))
def span_median_threshold(spark, sf_dir):
    return layout.median_font_size(planted.planted_spans(spark, sf_dir))


@query(
    "block_assembly",
    build("SELECT doc_id, page, block_no, text, max_size, is_bold FROM blocks", "blocks"),
)
def block_assembly(spark, sf_dir):
    blocks = layout.text_blocks(planted.planted_spans(spark, sf_dir))
    return _long(blocks.select("doc_id", "page", "block_no", "text", "max_size", "is_bold"), "page", "block_no")


@query("header_flags", build("SELECT doc_id, block_no, seq, is_header FROM headed", "headed"))
def header_flags(spark, sf_dir):
    return _long(_blocks(spark, sf_dir).select("doc_id", "block_no", "seq", "is_header"), "block_no", "seq")


@query(
    "section_match",
    f"SELECT doc_id, n, {match_section('line')} AS section FROM (SELECT doc_id, n - 1 AS n, line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n))",
)
def section_match(spark, sf_dir):
    return _matched_lines(spark, sf_dir, "strict")


@query(
    "section_match_compat",
    f"SELECT doc_id, n, {match_section('line', 'compat')} AS section FROM (SELECT doc_id, n - 1 AS n, line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n))",
)
def section_match_compat(spark, sf_dir):
    return _matched_lines(spark, sf_dir, "compat")


def _matched_lines(spark, sf_dir, mode):
    lines = planted.documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return _long(layout.with_section_match(lines, "line", "section", mode).drop("line"), "n")


@query("section_boundary", build("SELECT doc_id, seq, boundary FROM bounded WHERE boundary IS NOT NULL", "bounded"))
def section_boundary(spark, sf_dir):
    return _blocks(spark, sf_dir).where("boundary is not null").select("doc_id", "seq", "boundary")


@query("section_carry_forward", build("SELECT doc_id, seq, section FROM carried", "carried"))
def section_carry_forward(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "seq", "section")


@query(
    "section_blocks",
    build(
        "SELECT doc_id, seq, section, text FROM carried WHERE boundary IS NULL AND length(text) >= 20 AND section <> 'references'",
        "carried",
    ),
)
def section_blocks(spark, sf_dir):
    return layout.section_blocks(_blocks(spark, sf_dir)).select("doc_id", "seq", "section", "text")


@query("section_concat", build("SELECT doc_id, section, section_order, text FROM sections", "sections"))
def section_concat(spark, sf_dir):
    return _long(_sections(spark, sf_dir), "section_order")


@query(
    "section_concat_compat",
    build("SELECT doc_id, section, section_order, text FROM sections_compat", "sections_compat"),
)
def section_concat_compat(spark, sf_dir):
    return _long(_sections(spark, sf_dir, "compat"), "section_order")


@query(
    "sections_found",
    build(
        f"SELECT doc_id, n_sections, sections_found, {strip('full_text')} AS full_text FROM doc_texts", "doc_texts"
    ),
)
def sections_found(spark, sf_dir):
    docs = layout.with_full_text(layout.document_sections(_blocks(spark, sf_dir)))
    return docs.select(
        "doc_id",
        F.size("sections").cast("bigint").alias("n_sections"),
        F.array_join("sections_found", ",").alias("sections_found"),
        F.trim("full_text").alias("full_text"),
    )


@query(
    "sections_fallback",
    build("SELECT doc_id, section, section_order, text FROM line_sections", "line_sections"),
)
def sections_fallback(spark, sf_dir):
    """Plain lines as blocks: many documents have no usable line and fall back."""
    blocks = layout.blocks_from_lines(planted.documents(spark, sf_dir))
    return _long(layout.sections_of_blocks(blocks), "section_order")


@query("html_sections", build("SELECT doc_id, section, section_order, text FROM html_sections", "html_sections"))
def html_sections(spark, sf_dir):
    blocks = layout.blocks_from_html(planted.table(spark, sf_dir, "pages", "page_id"))
    return _long(layout.sections_of_blocks(blocks), "section_order")


@query(
    "section_summaries",
    build(
        "SELECT doc_id, section, section_order, summary, is_short FROM section_summaries",
        "section_summaries",
        texts="SELECT * FROM long_sections",
    ),
)
def section_summaries(spark, sf_dir):
    docs = stage(layout.document_sections(_blocks(spark, sf_dir)), "documents")
    return _long(summarize.summarize_sections(layout.section_rows(docs)), "section_order")


@query(
    "overall_summary",
    build("SELECT doc_id, overall_summary FROM overall", "overall", texts="SELECT * FROM long_sections"),
)
def overall_summary(spark, sf_dir):
    docs = stage(layout.document_sections(_blocks(spark, sf_dir)), "documents")
    return summarize.roll_up(summarize.summarize_sections(layout.section_rows(docs)))


@query(
    "keyword_topk_section",
    build(
        "SELECT doc_id, section, term, round(score, 6) AS score, rank FROM keyword_ranks WHERE rank <= 5",
        "keyword_ranks",
        keyword_input="SELECT doc_id, section, text FROM sections",
    ),
)
def keyword_topk_section(spark, sf_dir):
    top = keywords.top_keywords(_sections(spark, sf_dir), ["doc_id", "section"], 5)
    return _long(top.select("doc_id", "section", "term", F.round("score", 6).alias("score"), "rank"), "rank")


@query(
    "keyword_count_by_section",
    build(
        "SELECT section, count(*) AS n_keywords FROM keyword_ranks WHERE rank <= 5 GROUP BY section",
        "keyword_ranks",
        keyword_input="SELECT doc_id, section, text FROM sections",
    ),
)
def keyword_count_by_section(spark, sf_dir):
    return keywords.count_by_section(keywords.top_keywords(_sections(spark, sf_dir), ["doc_id", "section"], 5))


_META = "SELECT doc_id, substr(text, 1, 80) AS title, [lang, source] AS authors, '2024-01-01' AS published, lang AS primary_category FROM documents"

_RECORD_BLOCKS = dict(
    texts="SELECT * FROM long_sections",
    entity_input="SELECT doc_id, full_text AS text FROM doc_texts",
    method="SELECT doc_id, text FROM sections WHERE section = 'methodology'",
    keyword_input="SELECT doc_id, 'all' AS section, overall_summary AS text FROM overall",
    meta=_META,
    typed="""SELECT doc_id, type, string_agg(entity, ', ' ORDER BY rank) AS names, count(*) AS n FROM entity_ranks GROUP BY ALL""",
    paper_keywords="SELECT doc_id, string_agg(term, ', ' ORDER BY rank) AS words, count(*) AS n FROM keyword_ranks WHERE rank <= 10 GROUP BY doc_id",
    records="""
    SELECT m.*, d.sections_found, d.n_sections, len(regexp_extract_all(d.full_text, '[^\\s]+')) AS num_words_original,
        coalesce(o.overall_summary, '') AS overall_summary, coalesce(len(regexp_extract_all(o.overall_summary, '[^\\s]+')), 0) AS num_words_summary,
        coalesce(k.words, '') AS overall_keywords, coalesce(k.n, 0) AS n_keywords, c.chart AS methodology_flowchart,
        coalesce(e1.names, '') AS models, coalesce(e1.n, 0) AS n_models, coalesce(e2.names, '') AS datasets, coalesce(e2.n, 0) AS n_datasets,
        coalesce(e3.names, '') AS metrics, coalesce(e4.names, '') AS frameworks
    FROM meta m JOIN doc_texts d USING (doc_id) LEFT JOIN overall o USING (doc_id) LEFT JOIN paper_keywords k USING (doc_id)
    LEFT JOIN charts c USING (doc_id)
    LEFT JOIN (SELECT * FROM typed WHERE type = 'models') e1 USING (doc_id)
    LEFT JOIN (SELECT * FROM typed WHERE type = 'datasets') e2 USING (doc_id)
    LEFT JOIN (SELECT * FROM typed WHERE type = 'frameworks') e4 USING (doc_id)
    LEFT JOIN (SELECT * FROM typed WHERE type = 'metrics') e3 USING (doc_id)""",
    both_texts="SELECT doc_id, overall_summary, substr(text, 1, 2000) AS abstract FROM records JOIN documents USING (doc_id)",
    words_of_both=f"""SELECT doc_id, term, sum(c) AS c, sum(r) AS r FROM (
        SELECT doc_id, unnest({tokens('overall_summary')}) AS term, 1 AS c, 0 AS r FROM both_texts
        UNION ALL SELECT doc_id, unnest({tokens('abstract')}), 0, 1 FROM both_texts) GROUP BY ALL""",
)


def _record_sql(final: str, *more: str) -> str:
    return build(
        final, "meta", "doc_texts", "overall", "entity_ranks", "typed", "keyword_ranks", "paper_keywords", "charts", "records",
        *more, **_RECORD_BLOCKS,
    )


def metadata(spark, sf_dir):
    return planted.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.substring("text", 1, 80).alias("title"),
        F.array("lang", "source").alias("authors"),
        F.lit("2024-01-01").alias("published"),
        F.col("lang").alias("primary_category"),
    )


def _docs_with_entities(spark, sf_dir):
    """Planted spans of planted texts, so that sections hold entity names."""
    return record.records_from_spans(planted.planted_spans(spark, sf_dir), metadata(spark, sf_dir))


@query(
    "paper_record",
    _record_sql(
        """SELECT doc_id, title, sections_found, num_words_original, num_words_summary, overall_summary, overall_keywords,
        methodology_flowchart, models, datasets, metrics, frameworks FROM records"""
    ),
)
def paper_record(spark, sf_dir):
    full = _docs_with_entities(spark, sf_dir)
    return full.select(
        "doc_id", "title", F.array_join("sections_found", ",").alias("sections_found"), "num_words_original", "num_words_summary",
        "overall_summary", F.array_join("overall_keywords", ", ").alias("overall_keywords"), "methodology_flowchart",
        *(F.array_join(f"entities.{t}", ", ").alias(t) for t in ("models", "datasets", "metrics", "frameworks")),
    )


_RECORD_SECTIONS = """SELECT s.doc_id, s.section, s.section_order, s.summary, coalesce(k.words, '') AS keywords
        FROM section_summaries s LEFT JOIN section_words k ON k.doc_id = s.doc_id AND k.section = s.section"""


@query(
    "record_sections",
    build(
        _RECORD_SECTIONS, "section_summaries", "keyword_ranks", "section_words",
        texts="SELECT * FROM long_sections",
        keyword_input="SELECT doc_id, section, summary AS text FROM section_summaries WHERE NOT is_short",
        section_words="SELECT doc_id, section, string_agg(term, ', ' ORDER BY rank) AS words FROM keyword_ranks WHERE rank <= 5 GROUP BY ALL",
    ),
)
def record_sections(spark, sf_dir):
    """The section summaries and section keywords of the records."""
    full = _docs_with_entities(spark, sf_dir).select("doc_id", F.explode_outer("section_list").alias("s")).where("s IS NOT NULL")
    return full.select("doc_id", "s.section", F.col("s.section_order").cast("bigint").alias("section_order"), "s.summary", F.array_join("s.keywords", ", ").alias("keywords"))


@query(
    "record_scores",
    _record_sql(
        """SELECT r.doc_id, n_overlap, round(n_overlap / n_candidate, 6) AS precision, round(n_overlap / n_reference, 6) AS recall FROM (
            SELECT doc_id, sum(least(c, r)) AS n_overlap, sum(c) AS n_candidate, sum(r) AS n_reference FROM words_of_both GROUP BY doc_id
        ) r WHERE n_candidate > 0 AND n_reference > 0""",
        "both_texts", "words_of_both",
    ),
)
def record_scores(spark, sf_dir):
    """Each record's summary against its abstract, which the records keep beside it."""
    abstracts = planted.documents(spark, sf_dir).select("doc_id", F.substring("text", 1, 2000).alias("abstract_original"))
    meta = metadata(spark, sf_dir).join(abstracts, "doc_id")
    scored = record.scores(record.records_from_spans(planted.planted_spans(spark, sf_dir), meta))
    return scored.select("doc_id", "n_overlap", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "comparison_table",
    _record_sql(
        """SELECT doc_id, substr(title, 1, 50) || '...' AS title, num_words_original AS words_original, num_words_summary AS words_summary,
        round((1.0::DOUBLE - num_words_summary::DOUBLE / nullif(num_words_original, 0)) * 100, 1) AS compression_percent,
        n_sections, n_keywords, n_datasets, n_models FROM records"""
    ),
)
def comparison_table(spark, sf_dir):
    table = summarize.comparison_table(_docs_with_entities(spark, sf_dir))
    return _long(table, "n_sections", "n_keywords", "n_datasets", "n_models")


_N = " || chr(10) || chr(10) "
_MARKDOWN = f"""SELECT r.doc_id, '# ' || title{_N}|| '**Authors:** ' || array_to_string(authors, ', '){_N}|| '**Published:** ' || published{_N}
    || '**Category:** ' || primary_category{_N}|| '## Summary'{_N}|| overall_summary{_N}|| '## Keywords'{_N}|| overall_keywords{_N}
    || '## Entities'{_N}|| '- **Datasets:** ' || datasets || chr(10) || '- **Models:** ' || models || chr(10) || '- **Metrics:** ' || metrics{_N}
    || coalesce('## Section Summaries'{_N}|| parts, '') AS markdown
    FROM records r LEFT JOIN (
        SELECT doc_id, string_agg('### ' || array_to_string(list_transform(string_split(section, '_'), lambda w: upper(w[1]) || w[2:]), '_'){_N}|| summary{_N}, '' ORDER BY section_order) AS parts
        FROM section_summaries GROUP BY doc_id) s ON s.doc_id = r.doc_id"""


@query("markdown_export", _record_sql(_MARKDOWN))
def markdown_export(spark, sf_dir):
    return _docs_with_entities(spark, sf_dir).select("doc_id", writers.markdown().alias("markdown"))


@query(
    "json_export",
    _record_sql(
        """SELECT r.doc_id, title, overall_summary, overall_keywords, coalesce(n, 0) AS n_section_summaries, methodology_flowchart FROM records r
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM section_summaries GROUP BY doc_id) s ON s.doc_id = r.doc_id"""
    ),
)
def json_export(spark, sf_dir):
    """Records written as JSON lines and read back."""
    path = fresh_path(spark, "json-export")
    writers.write_records(record.export_form(_docs_with_entities(spark, sf_dir)), path)
    back = spark.read.schema("doc_id BIGINT, title STRING, overall_summary STRING, overall_keywords ARRAY<STRING>, section_summaries MAP<STRING, STRING>, methodology_flowchart STRING").json(path)
    return back.select(
        "doc_id", "title", "overall_summary", F.array_join("overall_keywords", ", ").alias("overall_keywords"),
        F.size("section_summaries").cast("bigint").alias("n_section_summaries"), "methodology_flowchart",
    )


@query(
    "saved_summary_list",
    build(
        """SELECT d.doc_id::VARCHAR AS summary_id, substr(d.text, 1, 80) AS title, d.lang || ',' || d.source AS authors, t.n_sections AS sections
        FROM documents d JOIN doc_texts t USING (doc_id)""",
        "doc_texts",
    ),
)
def saved_summary_list(spark, sf_dir):
    """Saved records, partitioned by category, read with the full schema and listed."""
    docs = layout.with_full_text(layout.document_sections(_blocks(spark, sf_dir))).select("doc_id", "sections_found")
    saved = metadata(spark, sf_dir).join(docs, "doc_id").withColumn("arxiv_id", F.col("doc_id").cast("string"))
    path = fresh_path(spark, "saved-summaries")
    writers.write_records(saved.drop("doc_id"), path, partition_by="primary_category")
    listed = readers.list_summaries(readers.read_saved_summaries(spark, path, one_per_file=False))
    return listed.select(
        "summary_id", "title", F.array_join("authors", ",").alias("authors"), F.col("sections").cast("bigint").alias("sections")
    )


@query(
    "markdown_brief",
    f"""SELECT doc_id, '# ' || substr(text, 1, 80){_N} || '**Authors:** ' || lang || ', ' || source{_N}
        || CASE WHEN text <> '' THEN '## Summary'{_N} || text{_N} ELSE '' END
        || CASE WHEN lang <> 'en' THEN '## Keywords'{_N} || source{_N} ELSE '' END AS markdown FROM documents""",
)
def markdown_brief(spark, sf_dir):
    docs = planted.documents(spark, sf_dir).select(
        "doc_id", F.substring("text", 1, 80).alias("title"), F.array("lang", "source").alias("authors"), F.col("text").alias("overall_summary"),
        F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("source")).alias("overall_keywords"),
    )
    return docs.select("doc_id", writers.markdown("brief").alias("markdown"))


@query(
    "upload_defaults",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE 'paper.' || doc_id END AS title, CASE WHEN lang = 'de' THEN lang ELSE '' END AS authors,
        CASE WHEN lang = 'en' THEN doc_id::VARCHAR ELSE 'uploaded' END AS arxiv_id, '2024-05-06' AS published,
        CASE WHEN lang = 'fr' THEN lang ELSE 'Unknown' END AS primary_category FROM documents""",
)
def upload_defaults(spark, sf_dir):
    lang = F.col("lang")
    docs = planted.documents(spark, sf_dir).select(
        "doc_id",
        F.when(lang == "en", F.col("source")).alias("title"),
        F.when(lang == "de", F.array(lang)).alias("authors"),
        F.when(lang == "en", F.col("doc_id").cast("string")).alias("arxiv_id"),
        F.lit(None).cast("string").alias("published"),
        F.when(lang == "fr", lang).alias("primary_category"),
        F.concat(F.lit("/up/paper."), F.col("doc_id"), F.lit(".pdf")).alias("pdf_path"),
    )
    filled = readers.with_paper_defaults(docs, F.lit("2024-05-06").cast("date")).drop("pdf_path")
    return filled.withColumn("authors", F.array_join("authors", ","))


@query(
    "published_dates",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published FROM orders",
)
def published_dates(spark, sf_dir):
    """Dates as the two kinds of papers give them, and one form that is no date."""
    at = F.col("o_orderdate")
    given = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")))
        .when(F.col("o_orderstatus") == "O", F.date_format(at, "yyyy-MM-dd"))
        .otherwise(F.lit("unknown"))
    )
    orders = planted.table(spark, sf_dir, "orders").select("o_orderkey", tx.published_at(given).alias("at"))
    return orders.select("o_orderkey", F.date_format("at", "yyyy-MM-dd").alias("published"))


@query("versioned_rewrite", build("SELECT id, user_id FROM summaries WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", "summaries"))
def versioned_rewrite(spark, sf_dir):
    """A table written, then rewritten without the rows of some users, then read in its newest version."""
    path = fresh_path(spark, "summaries")
    writers.write_version(planted.orders_as_summaries(spark, sf_dir), path)
    deleted = planted.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    writers.write_version(maintenance.cascade_delete(writers.read_version(spark, path), deleted), path)
    return writers.read_version(spark, path).select("id", "user_id")


@query(
    "activity_window_counts",
    """SELECT strftime(day, '%Y-%m-%d') AS day, event_type, n FROM (
        SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
    WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def activity_window_counts(spark, sf_dir):
    """Closed daily windows of the event stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    sink = fresh_path(spark, "window-counts")
    activity.write_counts(activity.window_counts(stream), sink, fresh_path(spark, "window-counts-state")).awaitTermination()
    counts = spark.read.schema("window_start TIMESTAMP, event_type STRING, n BIGINT").parquet(sink)
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(
    "activity_open_windows",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, coalesce(event_type, 'other') AS event_type, count(*) AS n FROM events GROUP BY ALL",
)
def activity_open_windows(spark, sf_dir):
    """Daily windows of the event stream, those still open included: all rows are counted."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    sink = fresh_path(spark, "open-windows")
    activity.write_open_counts(activity.window_counts(stream), sink, fresh_path(spark, "open-windows-state")).awaitTermination()
    counts = activity.read_open_counts(spark, sink)
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(
    "entity_pieces",
    build(
        "SELECT doc_id, type, entity, freq::BIGINT AS freq, rank::INTEGER AS rank FROM entity_ranks WHERE rank <= 15",
        "doc_texts", "entity_ranks",
        entity_input="SELECT doc_id, full_text AS text FROM doc_texts WHERE full_text IS NOT NULL",
    ),
)
def entity_pieces(spark, sf_dir):
    """Entities of documents that are never put together: their sections come as pieces with seams."""
    pieces = layout.with_seams(layout.section_pieces(_blocks(spark, sf_dir)))
    return entities.rank_pieces(pieces)


@query("stream_ingest", build("SELECT doc_id, section, section_order, text FROM sections", "sections"))
def stream_ingest(spark, sf_dir):
    """Spans delivered as files, as many as the texts ask for, taken in as a stream in two batches; every file is delivered twice."""
    landing = fresh_path(spark, "landing")
    files = max(4, tasks_for(planted.table(spark, sf_dir, "documents")))
    spans = planted.planted_spans(spark, sf_dir).repartition(files, "doc_id").sortWithinPartitions("doc_id", "line_no")
    spans.write.parquet(landing)
    spans.write.mode("append").parquet(landing)
    sink = fresh_path(spark, "ingested")
    stream = ingest.read_span_stream(spark, landing, files_per_batch=files * 5 // 4)
    ingest.ingest(stream, sink, fresh_path(spark, "ingest-state")).awaitTermination()
    docs = spark.read.schema("doc_id BIGINT, sections ARRAY<STRUCT<section: STRING, text: STRING>>").parquet(sink)
    return _long(layout.section_rows(docs), "section_order")
