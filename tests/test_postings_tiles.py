import numpy as np
import pytest
from pyspark.sql import functions as F

from quireworks.operators import evaluate, library
from quireworks.operators.postings import Postings


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    rows = [(i, f"common Word{i % 5} the model {'model' if i % 3 else ''}", ["Ann Common", f"name{i % 7}"]) for i in range(300)] + [(900, None, None), (901, "", [])]
    papers = spark.createDataFrame(rows, "id long, title string, authors array<string>").repartition(4)
    postings = Postings(str(tmp_path / "postings"), buckets=8, block=64).build(papers)
    for terms in (["common"], ["model", "name3", "THE"], ["word1", "word2", "absent"], ["absent"], ["the"]):
        expected = {(r["id"], r["score"]) for r in library.weighted_search(papers, terms).collect()}
        assert {tuple(r) for r in postings.search(spark, terms).collect()} == expected
    top = [tuple(r) for r in postings.search(spark, ["model", "common"], limit=5).collect()]
    assert top == [(r["id"], r["score"]) for r in library.weighted_search(papers, ["model", "common"], limit=5).collect()]
    # a word of every paper is several rows, and a search reads the folders of its words only
    assert spark.read.parquet(postings.path).where("term = 'common'").count() > 1
    assert len({f.rsplit("/", 2)[1] for f in postings.search(spark, ["absent"]).inputFiles()}) <= 8
    plan = postings.search(spark, ["common"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("block", [7, 512])
def test_tiled_match_by_brute_force(spark, block):
    rng = np.random.default_rng(6)
    sizes = {1: (30, 45), 2: (1, 8), 3: (5, 0), 4: (2, 2)}
    sides = {p: [rng.normal(size=(n, 6)) for n in both] for p, both in sizes.items()}
    sides[4][0][0] = 0
    rows = [(p, s, i, v.tolist()) for p, both in sides.items() for s in (0, 1) for i, v in enumerate(both[s])]
    found = {r["pair"]: r for r in evaluate.greedy_match_tiled(spark.createDataFrame(rows, "pair long, side int, pos long, vector array<double>"), block).collect()}
    assert set(found) == {1, 2, 4}
    for p in found:
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in sides[p])
        cosines = a @ b.T
        precision, recall = cosines.max(axis=1).mean(), cosines.max(axis=0).mean()
        assert abs(found[p]["precision"] - precision) < 1e-9 and abs(found[p]["recall"] - recall) < 1e-9
    whole = spark.createDataFrame([(1, sides[1][0].tolist(), sides[1][1].tolist())], "pair long, c array<array<double>>, r array<array<double>>")
    assert abs(evaluate.greedy_match(whole, "c", "r").first()["f1"] - found[1]["f1"]) < 1e-9


def test_long_sides_stay_in_blocks(spark):
    """Three thousand vectors on each side; each is its own best match."""
    n = 3000
    base = spark.range(n).select(F.lit(1).cast("long").alias("pair"), F.col("id").alias("pos"), F.array(*(F.sin(F.col("id") * k + k) for k in range(1, 9))).alias("vector"))
    both = base.withColumn("side", F.lit(0)).unionByName(base.withColumn("side", F.lit(1)))
    row = evaluate.greedy_match_tiled(both).first()
    assert abs(row["precision"] - 1) < 1e-9 and abs(row["recall"] - 1) < 1e-9
