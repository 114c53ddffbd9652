"""Every registered query against its SQL on the smallest tables."""

import pytest
from settings import SF_DIR

import __spark_entry__ as contract
from check_oracle import rows_of
from quireworks.checks.registry import ORACLES, QUERIES

# the training-data queries have their own tests


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == rows_of(columns, cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
