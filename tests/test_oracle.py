"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from oracle import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = list(entry.REGISTERED)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CORE)
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns, expected = sql_rows(con, SQL[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == expected


def test_entry_is_the_change_feed(spark):
    feed = entry.entry(spark)
    assert {r.op for r in feed.collect()} == {"insert", "update", "delete"}


def test_every_query_has_sql():
    assert set(CORE) <= set(SQL)
