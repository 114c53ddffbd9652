import re

import pytest
from pyspark.sql import functions as F

from quireworks.operators import library
from quireworks.operators.paging import RankIndex

ROWS = [(i, None if i % 11 == 0 else f"t{i * 37 % 20:02d}") for i in range(403)]


def table(spark):
    return spark.createDataFrame(ROWS, "id long, paper_title string").repartition(5)


def in_order(descending):
    nulls = [r for r in ROWS if r[1] is None]
    rest = sorted((r for r in ROWS if r[1] is not None), key=lambda r: r[0])
    rest.sort(key=lambda r: r[1], reverse=descending)
    return [*nulls, *rest] if descending else [*rest, *nulls]


@pytest.mark.parametrize("descending", [True, False])
def test_every_page_and_the_page_after_it(spark, tmp_path, descending):
    index = RankIndex(str(tmp_path / "index"), "paper_title", descending).build(table(spark), ranges=8)
    expected, seen, per_page = in_order(descending), [], 90
    assert index.total(spark) == len(ROWS)
    for page in range(1, 7):
        rows = index.page(spark, page, per_page).collect()
        assert all((r["total"], r["total_pages"]) == (403, 5) for r in rows)
        assert [(r["id"], r["paper_title"]) for r in rows] == expected[(page - 1) * per_page : page * per_page]
        if rows:
            after = index.after(spark, rows[-1]["paper_title"], rows[-1]["id"], per_page).collect()
            assert [(r["id"], r["paper_title"]) for r in after] == expected[page * per_page : (page + 1) * per_page]
    again = library.page_of(table(spark), library.sort_order("paper_title", descending), 3, 7).collect()
    assert sorted(again) == sorted(index.page(spark, 3, 7).select(*again[0].__fields__).collect())


def test_a_deep_page_reads_its_range_only(spark, tmp_path):
    index = RankIndex(str(tmp_path / "index"), "paper_title").build(table(spark), ranges=8)
    page = index.page(spark, 30, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*range_no", plan) and "Limit" not in plan and "TakeOrdered" not in plan
    page.collect()
    read = page._jdf.queryExecution().executedPlan().toString()
    assert page.count() == 10, read
    tracker = spark.read.parquet(f"{index.path}/rows").where(F.col("range_no").isin([r["range_no"] for r in index._ranges(spark)]))
    assert len(tracker.inputFiles()) >= 6  # there are many ranges to choose from


def test_empty_and_wrong(spark, tmp_path):
    index = RankIndex(str(tmp_path / "index"), "paper_title").build(table(spark).where("id < 0"), ranges=4)
    assert index.page(spark) is None and index.after(spark, "t", 1) is None and index.total(spark) == 0
    with pytest.raises(ValueError):
        RankIndex(str(tmp_path / "other"), "no_such").build(table(spark))
    with pytest.raises(ValueError):
        index.page(spark, 0)
