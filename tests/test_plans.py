"""Physical plans: what must not appear in any of them, and what must in some."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from settings import SF_DIR

import __spark_entry__ as contract
from quireworks.checks import planted, text_queries
from quireworks.functions.skew import salted_join
from quireworks.operators import keywords, layout, library, summarize
from quireworks.staging import fresh_path

QUERIES = contract.queries()
PYTHON = {"encoder_scores"}  # the encoder hook is the one place for Python code


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (?:hash|range|Single|Round)\w*", plan_of(df))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_rows_and_no_cross_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for bad in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert bad not in plan
    assert ("ArrowEvalPython" in plan) == (name in PYTHON)


def test_ranking_moves_the_texts_once(spark):
    """Scores, ranks, budget and reassembly all find their rows in place after one shuffle."""
    df = summarize.summarize_sections(
        spark.read.parquet(f"{SF_DIR}/documents.parquet").select(
            "doc_id", F.lit("all").alias("section"), F.lit(0).alias("section_order"), "text"
        )
    )
    assert len(exchanges(df)) == 1
    assert plan_of(df).count("Scan parquet") == 1


def test_entities_and_steps_do_not_shuffle(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    from quireworks.operators import entities, flow

    assert exchanges(entities.rank(docs)) == []
    assert exchanges(flow.edges(docs)) == []


def test_top_n_is_limited_before_the_shuffle(spark):
    plan = plan_of(library.latest_per_user(planted.activity(spark, SF_DIR)))
    before, after = plan.split("Exchange hashpartitioning", 1)
    assert "row_number(), 10, Final" in before and "row_number(), 10, Partial" in after


def test_statistics_join_one_row_per_user(spark):
    """Summaries are aggregated below the join, with a partial step before the shuffle."""
    plan = plan_of(library.user_summary_stats(planted.users(spark, SF_DIR), planted.orders_as_summaries(spark, SF_DIR).withColumn("word_count", F.lit(1))))
    join_at, aggregate_at = plan.index("Join"), plan.index("HashAggregate")
    assert join_at < aggregate_at and "partial_count" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(library.scoped(planted.activity(spark, SF_DIR), 8).select("id"))
    assert "EqualTo(user_id,8)" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan
    recent = plan_of(library.monthly_counts(planted.orders_as_summaries(spark, SF_DIR), F.lit("2001-08-01").cast("timestamp")))
    assert "o_totalprice" not in recent


def readers_of(spark, name, run):
    """The final plans of those jobs of ``run()``, whatever it stages, that read files named like ``name``; and all plans."""
    before = set(sql_ids(spark))
    run()
    plans = [plan for i, plan in sql_ids(spark).items() if i not in before]
    final = [p.split("== Final Plan ==")[-1].split("== Initial Plan ==")[0] for p in plans if name in p]
    return final, plans


def sql_ids(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    found = {}
    it = store.executionsList().iterator()
    while it.hasNext():
        e = it.next()
        found[e.executionId()] = e.physicalPlanDescription()
    return found


def test_layout_reads_its_spans_once(spark):
    """Sizes, headings and texts come from one scan; later jobs read what it wrote, and blocks do not move again by page."""
    source = fresh_path(spark, "counted-source")
    planted.planted_spans(spark, SF_DIR).repartition(16).write.parquet(source)
    final, plans = readers_of(spark, source.rsplit("/", 1)[1], lambda: layout.sections(spark.read.parquet(source)).collect())
    assert len(final) == 1 and final[0].count("Scan parquet") == 1
    assert "Bucketed: true" in max(plans, key=len)


def test_keywords_read_their_texts_once(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    final, _ = readers_of(spark, "documents.parquet", lambda: keywords.top_keywords(df, ["doc_id"], 5).collect())
    assert len(final) == 1 and final[0].count("Scan parquet") == 1


def test_keywords_need_no_shuffle_of_tokens(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    counted = keywords.term_counts(docs, ["doc_id"])
    assert len(exchanges(counted)) == 1 and "REPARTITION_BY_COL" in plan_of(counted)


def test_counts_survive_one_dominant_key(spark):
    """One user with most rows, one document text repeated: results stay whole."""
    rows = spark.range(0, 30_000, numPartitions=8).select(
        F.col("id"), F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id")).alias("user_id"),
        F.timestamp_seconds(F.col("id")).alias("created_at"), F.lit("view").alias("activity_type"),
    )
    latest = library.latest_per_user(rows)
    assert latest.where("user_id = 1").count() == 10
    assert latest.where("user_id <> 1").count() == 30_000 * 3 // 10
    text = "The same text of some length is stored again. It has a second sentence in it too. And there is a third one here."
    copies = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("all").alias("section"), F.lit(text).alias("text"))
    assert summarize.extractive_summary(copies).groupBy("summary").count().first()["count"] == 2_000
    top = keywords.top_keywords(copies.select("doc_id", "text"), ["doc_id"], 5)
    assert top.count() == 10_000


def test_hot_key_of_a_join_is_split(spark):
    """Half of the left rows share one key: the salted join returns the same rows, in split partitions."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.range(0, 200_000, 1, 8).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 1000).alias("k"))
        right = left.groupBy("k").agg(F.count("*").alias("n"))
        joined = salted_join(left, right, ["k"], ["id"])
        assert joined.columns == ["k", "id", "n"]
        rows = {r["k"]: r["count"] for r in joined.where("n > 0").groupBy("k").count().collect()}
        assert rows == {r["k"]: r["n"] for r in right.collect()}
        df = joined.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("k")))
        assert df.where("rank = 1").collect()
        df.collect()
        assert "SortMergeJoin(skew=true)" in plan_of(df)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_salted_left_join_keeps_rows_without_a_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, k string")
    right = spark.createDataFrame([("a", 5)], "k string, v int")
    assert sorted((r.id, r.v) for r in salted_join(left, right, ["k"], ["id"], "left").collect()) == [(1, 5), (2, None), (3, None)]


def test_whole_texts_stay_whole(spark):
    assert text_queries.whole_texts(spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
