"""The dashboard of every user: statistics, latest activity and monthly counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.operators import library


def dashboards(users: DataFrame, summaries: DataFrame, activity: DataFrame, as_of: Column) -> DataFrame:
    """One row per user. All three parts are reduced per user before they are joined."""
    stats = library.with_dashboard_defaults(library.user_summary_stats(users, summaries))
    recent = (
        library.latest_per_user(activity)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list(F.struct("recency", "id", "activity_type", "created_at"))).alias("recent_activity"))
    )
    months = (
        library.monthly_counts(summaries, as_of)
        .groupBy("user_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("month", "n")))).alias("monthly_summaries"))
    )
    return (
        stats.join(recent, "user_id", "left")
        .join(months, "user_id", "left")
        .withColumn("recent_activity", F.coalesce("recent_activity", F.array()))
        .withColumn("monthly_summaries", F.coalesce("monthly_summaries", F.create_map().cast("map<string,bigint>")))
    )
