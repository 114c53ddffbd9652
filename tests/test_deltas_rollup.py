import datetime as dt
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from quireworks.operators import library, maintenance, rollup
from quireworks.sources import writers
from quireworks.sources.deltas import DeltaTable

NOW = dt.datetime(2024, 5, 6)
OLD = dt.datetime(2020, 1, 1)
USERS = [(i, i % 3, f"name {i}", f"bio {i}", OLD) for i in range(20)]
SCHEMA = "id long, user_id long, full_name string, bio string, updated_at timestamp"


def rows_of(df):
    return {r["id"]: (r["user_id"], r["full_name"], r["bio"], r["updated_at"]) for r in df.collect()}


def test_changes_give_what_rewrites_give(spark, tmp_path):
    base = spark.createDataFrame(USERS, SCHEMA)
    table = DeltaTable(str(tmp_path / "users"))
    assert table.create(base) == 1 and rows_of(table.read(spark)) == rows_of(base)
    first = spark.createDataFrame([(1, " new ", None, 9), (2, None, "b2", 9), (3, None, None, 9), (99, "nobody", None, 9)], "id long, full_name string, bio string, user_id long")
    second = spark.createDataFrame([(1, None, "b1"), (2, "n2", "b3")], "id long, full_name string, bio string")
    asked = spark.createDataFrame([(4, 1), (5, 0)], "id long, user_id long")  # the second is not its owner
    owners = spark.createDataFrame([(0,), (0,)], "user_id long")
    now = F.lit(NOW)
    expected = maintenance.patch(maintenance.patch(base, first, now), second, now)
    expected = maintenance.cascade_delete(maintenance.owner_delete(expected, asked), owners)
    assert [table.patch(first, now), table.patch(second, now), table.owner_delete(asked), table.cascade_delete(owners)] == [1, 2, 3, 4]
    assert rows_of(table.read(spark)) == rows_of(expected)
    assert rows_of(table.read(spark, 1)) == rows_of(maintenance.patch(base, first, now))
    assert table.compact(spark) == 2 and rows_of(table.read(spark)) == rows_of(expected)
    # the new version begins without changes, and takes new ones
    assert table.owner_delete(spark.createDataFrame([(1, 1)], "id long, user_id long")) == 1
    assert set(rows_of(table.read(spark))) == set(rows_of(expected)) - {1}


def test_a_change_is_as_large_as_itself(spark, tmp_path):
    rows = spark.range(200_000).select("id", (F.col("id") % 50).alias("user_id"), F.uuid().alias("full_name"), F.uuid().alias("bio"), F.lit(OLD).alias("updated_at"))
    table = DeltaTable(str(tmp_path / "users"))
    table.create(rows)
    table.patch(spark.createDataFrame([(7, "x")], "id long, full_name string"), F.lit(NOW))

    def size(folder):
        return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))

    assert size(tmp_path / "users" / "changes") < size(tmp_path / "users" / "version=1") / 100
    assert table.read(spark).where("full_name = 'x'").count() == 1 and writers.versions(spark, table.path) == [1]


def summaries(spark):
    rows = [
        (i, None if i % 13 == 0 else i % 4, None if i % 5 == 0 else Decimal(i * 7) / 3, None if i % 3 == 0 else i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * 31))
        for i in range(150)
    ]
    rows += [(None, 1, Decimal(5), 7, dt.datetime(2024, 2, 2)), (900, 2, None, None, None), (901, 7, None, None, dt.datetime(2024, 3, 1, 23, 59))]
    schema = "id long, user_id long, processing_time_seconds decimal(10,2), word_count long, created_at timestamp"
    return spark.createDataFrame(rows, schema)


def test_states_of_appended_parts_give_the_statistics_of_all(spark, tmp_path):
    users = spark.createDataFrame([(i, f"u{i}") for i in range(9)], "id long, email string")
    every, path = summaries(spark), str(tmp_path / "states")
    for part in ("id % 3 = 0", "id % 3 <> 0 OR id IS NULL"):
        writers.append_rows(rollup.user_days(every.where(part)), path)
    states = spark.read.parquet(path)
    expected = library.user_summary_stats(users, every)
    for found in (rollup.user_stats(users, states), rollup.user_stats(users, rollup.merged(states))):
        assert found.columns == expected.columns and sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    as_of = F.lit("2024-07-01").cast("timestamp")
    wanted = sorted(map(repr, library.monthly_counts(every, as_of).collect()))
    assert sorted(map(repr, rollup.monthly_counts(states, as_of).collect())) == wanted and wanted
