"""Reads over papers, summaries, users and activity: search, pages, statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireworks.functions import text as tx
from quireworks.functions.lexicon import STOP_WORDS

DEFAULT_CATEGORY = "cs.LG"
PAPER_FIELDS = ("all", "topic", "title", "author", "abstract", "category")
SORTABLE = ("created_at", "updated_at", "paper_title", "arxiv_id", "word_count", "processing_time_seconds")


def paper_filter(field: str = "category", phrase: str = "") -> Column:
    """Predicate on papers for a phrase in one field or, with ``all``, in any text field.

    An empty phrase selects the default category.
    """
    phrase = phrase.strip()
    if field not in PAPER_FIELDS:
        raise ValueError(f"field must be one of {PAPER_FIELDS}")
    if not phrase:
        return F.col("primary_category") == DEFAULT_CATEGORY
    tests = {
        "title": tx.contains_ci(F.col("title"), phrase),
        "author": F.exists("authors", lambda a: tx.contains_ci(a, phrase)),
        "abstract": tx.contains_ci(F.col("summary"), phrase),
        "category": F.col("primary_category") == phrase,
    }
    if field in tests:
        return tests[field]
    return tests["title"] | tests["author"] | tests["abstract"] | tests["category"]


def search_papers(papers: DataFrame, condition: Column, limit: int | None = None) -> DataFrame:
    """Matching papers, newest first; ``limit`` is the number of results asked for."""
    hits = papers.where(condition).orderBy(F.desc_nulls_last("published"), "arxiv_id")
    return hits.limit(limit) if limit is not None else hits


def scoped(df: DataFrame, user_id: object, column: str = "user_id") -> DataFrame:
    """Rows of one owner. Apply it before anything else."""
    return df.where(F.col(column) == F.lit(user_id))


def any_contains(columns: Sequence[str], term: str) -> Column:
    """Case-insensitive containment in any of the columns; an empty term matches every row."""
    condition = F.lit(not term)
    for column in columns if term else ():
        condition = condition | F.coalesce(tx.contains_ci(F.col(column), term), F.lit(False))
    return condition


def sort_order(
    sort_by: str, descending: bool = True, tie_break: str = "id", allowed: Sequence[str] = SORTABLE
) -> list[Column]:
    """Sort columns as PostgreSQL orders them: nulls first when descending, last when ascending."""
    if sort_by not in allowed:
        raise ValueError(f"sort_by must be one of {tuple(allowed)}")
    first = F.desc_nulls_first(sort_by) if descending else F.asc_nulls_last(sort_by)
    return [first, F.asc(tie_break)]


def page_of(df: DataFrame, order: Sequence[Column], page: int = 1, per_page: int = 10) -> DataFrame:
    """One page of rows with ``total`` and ``total_pages`` on each row.

    The total is a scalar subquery with partial counts, not a window over all rows.
    """
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    total = df.agg(F.count("*").alias("n")).scalar()
    rows = df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    return rows.withColumn("total", total).withColumn("total_pages", F.ceil(F.col("total") / per_page).cast("bigint"))


def page_summary(df: DataFrame, page: int = 1, per_page: int = 10) -> dict[str, int]:
    """Totals alone, also right for a page without rows."""
    total = df.count()
    return {"total": total, "page": page, "per_page": per_page, "total_pages": math.ceil(total / per_page)}


def sort_results(df: DataFrame, by: str = "relevance", date: str = "published", rank: str = "relevance_rank") -> DataFrame:
    """Newest or oldest first, or the order kept in the rank column."""
    orders = {"newest": F.desc_nulls_last(date), "oldest": F.asc_nulls_last(date), "relevance": F.asc(rank)}
    return df.orderBy(orders[by], F.asc(rank))


def latest_per_user(activity: DataFrame, n: int = 10, user: str = "user_id", at: str = "created_at", tie_break: str = "id") -> DataFrame:
    """The latest ``n`` rows of each user with ``recency``.

    The constant rank limit is also applied before the shuffle, so a user with very
    many rows sends at most ``n`` from each task.
    """
    order = Window.partitionBy(user).orderBy(F.desc_nulls_last(at), F.asc(tie_break))
    return activity.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


def since_days(df: DataFrame, as_of: Column, days: int = 180, at: str = "created_at") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``."""
    return df.where(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))


def monthly_counts(summaries: DataFrame, as_of: Column, days: int = 180, user: str = "user_id", at: str = "created_at") -> DataFrame:
    """(user, month, n) over the last ``days`` days."""
    recent = since_days(summaries.select(user, at), as_of, days, at)
    return recent.groupBy(user, tx.month_key(F.col(at)).alias("month")).agg(F.count("*").alias("n"))


def activity_distribution(activity: DataFrame, kind: str = "activity_type", user: str = "user_id", **latest: object) -> DataFrame:
    """(user, activity_type, n) over each user's latest ten rows; missing types count as other."""
    recent = latest_per_user(activity, user=user, **latest)
    label = F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("other"))
    return recent.groupBy(user, label.alias("activity_type")).agg(F.count("*").alias("n"))


def user_summary_stats(users: DataFrame, summaries: DataFrame) -> DataFrame:
    """Statistics per user, including users without summaries.

    Summaries are reduced to one row per user before the join, with partial aggregates
    and de-duplicated days on the map side, so a user owning a large share of all rows
    does not end up in one task.
    """
    per_user = summaries.groupBy("user_id").agg(
        F.count("id").alias("total_summaries"),
        F.avg("processing_time_seconds").alias("avg_processing_time"),
        F.sum("word_count").alias("total_words_processed"),
        F.max("created_at").alias("last_summary_date"),
        F.count_distinct(F.to_date("created_at")).alias("active_days"),
    )
    return (
        users.select(F.col("id").alias("user_id"), "email")
        .join(per_user, "user_id", "left")
        .withColumn("total_summaries", F.coalesce("total_summaries", F.lit(0).cast("bigint")))
        .withColumn("active_days", F.coalesce("active_days", F.lit(0).cast("bigint")))
    )


def with_dashboard_defaults(stats: DataFrame) -> DataFrame:
    """Zero instead of null for the numbers shown on a dashboard."""
    return stats.withColumn(
        "avg_processing_time", F.coalesce(F.col("avg_processing_time").cast("double"), F.lit(0.0))
    ).withColumn("total_words_processed", F.coalesce("total_words_processed", F.lit(0).cast("bigint")))


def title_tokens(c: Column) -> Column:
    return tx.tokens(F.coalesce(c, F.lit("")))


def weighted_search(
    papers: DataFrame,
    terms: Sequence[str],
    title: str = "title",
    authors: str = "authors",
    weights: tuple[float, float] = (1.0, 0.4),
    limit: int | None = None,
    key: str = "id",
) -> DataFrame:
    """Papers scored by query words in title and authors, best first. No stemming; stop words do not count.

    Each paper is scored inside its row; only hits are sorted.
    """
    wanted = sorted({t.lower() for t in terms} - set(STOP_WORDS))

    def hits(c: Column) -> Column:
        return F.size(F.filter(title_tokens(c), lambda t: t.isin(wanted)))

    score = hits(F.col(title)) * F.lit(weights[0]) + hits(F.array_join(authors, " ")) * F.lit(weights[1])
    found = papers.withColumn("score", F.round(score, 6)).where("score > 0").orderBy(F.desc("score"), F.asc(key))
    return found.limit(limit) if limit is not None else found


def with_files(papers: DataFrame, files: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Papers with their file by identifier, so a missing file cannot shift the others."""
    return papers.join(files, key)


def attach(papers: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """All papers with their results, if any."""
    return papers.join(results, key, "left")
