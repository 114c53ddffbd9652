"""Schemas of the stored tables and files, as DDL."""

from __future__ import annotations

PAPERS = (
    "title STRING, authors ARRAY<STRING>, summary STRING, pdf_url STRING, arxiv_id STRING, "
    "published STRING, primary_category STRING"
)

SPANS = (
    "doc_id BIGINT, page INT, block_no INT, block_type INT, line_no INT, span_no INT, text STRING, "
    "size DOUBLE, font STRING, x0 DOUBLE, y0 DOUBLE"
)

ENTITIES = (
    "STRUCT<models: ARRAY<STRING>, datasets: ARRAY<STRING>, metrics: ARRAY<STRING>, "
    "frameworks: ARRAY<STRING>, techniques: ARRAY<STRING>>"
)

_SUMMARY_BODY = (
    "overall_summary STRING, section_summaries MAP<STRING, STRING>, "
    "section_keywords MAP<STRING, ARRAY<STRING>>, overall_keywords ARRAY<STRING>, "
    f"entities {ENTITIES}, methodology_flowchart STRING, sections_found ARRAY<STRING>"
)

# Every field that any saved summary file may hold; the optional ones read as null.
SUMMARY_FILE = (
    f"{_SUMMARY_BODY}, num_words_original BIGINT, num_words_summary BIGINT, title STRING, "
    "authors ARRAY<STRING>, arxiv_id STRING, published STRING, primary_category STRING, "
    "abstract_original STRING, pdf_path STRING, pdf_url STRING, bert_f1 DOUBLE, bert_precision DOUBLE, "
    "bert_recall DOUBLE, f1 DOUBLE, precision DOUBLE, recall DOUBLE"
)

USERS = (
    "id STRING, email STRING, password_hash STRING, full_name STRING, bio STRING, avatar_url STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP, last_login TIMESTAMP, is_active BOOLEAN"
)

SUMMARIES = (
    "id STRING, user_id STRING, paper_title STRING, paper_authors ARRAY<STRING>, paper_url STRING, "
    f"arxiv_id STRING, summary_data STRUCT<{_SUMMARY_BODY}, abstract_original STRING>, model_used STRING, "
    "processing_time_seconds DECIMAL(10,2), word_count INT, created_at TIMESTAMP, updated_at TIMESTAMP"
)

ACTIVITY = (
    "id STRING, user_id STRING, activity_type STRING, activity_data STRUCT<summary_id: STRING, "
    "paper_title: STRING, arxiv_id: STRING, processing_time: DOUBLE>, created_at TIMESTAMP"
)
