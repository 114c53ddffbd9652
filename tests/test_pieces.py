"""Documents in pieces: the same sections, texts and entities as in one row."""

import random

from pyspark.sql import functions as F
from test_layout import LONG, simple, spans_of

from quireworks.operators import entities, layout

FILL = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
NAMES = ["ResNet-50", "Vision Transformer", "BERT", "GPT-4", "ImageNet", "CIFAR-10", "F1-score", "accuracy", "PyTorch", "scikit-learn"]


def docs():
    rng = random.Random(3)
    out = {1: simple("#References", LONG), 2: simple("short"), 3: simple(LONG)}
    for d in range(4, 12):
        texts = []
        for _ in range(rng.choice([60, 140])):
            words = [rng.choice(FILL) for _ in range(rng.choice([4, 9]))] + rng.sample(NAMES, rng.choice([0, 1, 2]))
            rng.shuffle(words)
            texts.append(rng.choice(["#Results", "#Method"]) if rng.random() < 0.05 else " ".join(words))
        out[d] = simple(*texts)
    # a two-word name right over the end of a page
    out[20] = simple(*[LONG] * 49, "the text of this page ends with Vision", "Transformer begins the next one, see also Vision")
    return out


def test_pieces_put_together_are_the_sections(spark):
    blocks = layout.blocks_with_sections(spans_of(spark, docs()))
    whole = {(r["doc_id"], r["section"]): r["text"] for r in layout.section_rows(layout.document_sections(blocks)).collect() if r["text"]}
    pieces = layout.section_pieces(blocks)
    found = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["doc_id"], r["first"], r["place"])):
        key = (r["doc_id"], r["section"])
        found[key] = found[key] + r["glue"] + r["text"] if key in found else r["text"]
    assert found == whole
    assert pieces.count() > len(whole)
    seams = layout.with_seams(pieces).collect()
    for d in {r["doc_id"] for r in seams}:
        rows = sorted((r for r in seams if r["doc_id"] == d), key=lambda r: (r["first"], r["place"]))
        for before, after in zip(rows, rows[1:]):
            assert after["before"].endswith(before["text"][-20:]) and before["after"].startswith(after["text"][:20])
        assert rows[0]["before"] == "" and rows[-1]["after"] == ""


def test_entities_of_pieces_are_those_of_the_whole(spark):
    blocks = layout.blocks_with_sections(spans_of(spark, docs()))
    whole = layout.with_full_text(layout.document_sections(blocks)).where("full_text <> ''")
    expected = {tuple(r) for r in entities.rank(whole, "full_text").collect()}
    found = entities.rank_pieces(layout.with_seams(layout.section_pieces(blocks)))
    assert {tuple(r) for r in found.select("doc_id", "type", "entity", "freq", "rank").collect()} == expected
    assert (20, "models", "Vision Transformer") in {r[:3] for r in expected}


def test_a_long_document_is_spread(spark):
    """Many pages of one document: its blocks and pieces lie in many partitions."""
    pages = 3000
    spans = spark.range(pages * 4).select(
        F.lit(1).cast("bigint").alias("doc_id"), F.expr("int(id div 4)").alias("page"), F.expr("int(id % 4)").alias("block_no"), F.lit(0).alias("block_type"),
        F.lit(0).alias("line_no"), F.lit(0).alias("span_no"), F.concat(F.lit(LONG + " "), F.col("id").cast("string")).alias("text"),
        F.lit(10.0).alias("size"), F.lit("Times").alias("font"), F.lit(0.0).alias("x0"), F.expr("double(id % 4)").alias("y0"),
    )
    # so small a table would be one task, and its page rows sent to it
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    blocks = layout.blocks_with_sections(spans)
    sizes = [r["count"] for r in blocks.groupBy(F.spark_partition_id()).count().collect()]
    for key in settings:
        spark.conf.unset(key)
    assert len(sizes) == 4 and max(sizes) < 0.4 * sum(sizes) and sum(sizes) == pages * 4
    assert layout.section_pieces(blocks).count() == pages
    assert blocks.agg(F.max("seq"), F.count_distinct("seq")).first()[:] == (pages * 4, pages * 4)
