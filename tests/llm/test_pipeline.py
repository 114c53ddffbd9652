import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from quireworks.llm import common, mixing
from quireworks.llm.common import table
from tests.llm.test_neardup import brute
from tests.llm.test_pii import base


def test_each_stage_on_its_own_input(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, results[-1], sf_dir)
        results.append(spark.createDataFrame(result.collect(), result.schema))
        if name != "tokens":
            assert result.columns == docs.columns, name
    before, known, single, clean, mix, tokens = ([r.asDict() for r in df.collect()] for df in results)
    lettered = {r["doc_id"] for r in before if re.search(r"[^\W\d_]", r["text"] or "")}
    assert {r["doc_id"] for r in known} <= lettered and len(known) > 0.97 * len(lettered)
    groups = brute([(r["doc_id"], r["text"]) for r in known])
    assert {r["doc_id"] for r in single} == {i for i, (_, c) in groups.items() if i == c}
    assert [r["doc_id"] for r in sorted(clean, key=lambda r: r["doc_id"])] == sorted(r["doc_id"] for r in single)
    texts = {r["doc_id"]: r["text"] for r in single}
    for r in clean:
        assert not base(r["text"]) and r["n_chars"] == len(r["text"])
        if not base(texts[r["doc_id"]]) and "<" not in r["text"]:
            assert r["text"] == texts[r["doc_id"]]
    sources = {r["source"] for r in clean}
    shares = {s: sum(r["n_chars"] for r in mix if r["source"] == s) for s in sources}
    assert 0 < min(shares.values())
    assert len(tokens) == len(mix) and sorted(r["doc_id"] for r in tokens) == sorted(r["doc_id"] for r in mix)


def test_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_mix_reaches_target_weights(spark):
    rows = [(i, "a" if i % 3 else "b", "x" * 50) for i in range(9000)] + [(9000 + i, None, "y" * 50) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    mix = mixing.replicate(docs, {"a": 1, "b": 2, "": 1}).groupBy("source").count().collect()
    share = {r["source"]: r["count"] / 9050 for r in mix}
    assert abs(share["a"] - 0.25) < 0.03 and abs(share["b"] - 0.5) < 0.03 and abs(share[None] - 0.25) < 0.03
    again = mixing.replicate(docs.repartition(7), {"a": 1, "b": 2, "": 1}).groupBy("source").count().collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, mix), key=str)
    assert mixing.replicate(docs, {"b": 1}).where("source IS NULL OR source = 'a'").count() == 0


def test_workers_are_sent_few_rows_and_keep_nothing_of_other_operators(spark, monkeypatch):
    def looked_at(batches):
        for batch in batches:
            yield batch.append_column("rejected", pa.array([batch.num_rows > corpus_pipeline.ROWS] * batch.num_rows))

    monkeypatch.setattr(corpus_pipeline.language, "identify", lambda docs, model: docs.mapInArrow(looked_at, docs.withColumn("rejected", F.lit(False)).schema))
    rows = [(i, "some words", "en", "web", 10) for i in range(3 * corpus_pipeline.ROWS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert corpus_pipeline.known_language(spark, docs, "").count() == len(rows) and spark.conf.get(key) == before
    monkeypatch.setattr(common, "KEPT", {"bpe": {"file": object()}, "language": {"x": 1}})
    common.make_room("language")
    assert common.KEPT == {"language": {"x": 1}}
