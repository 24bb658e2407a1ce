"""Registered queries against their SQL on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from loanmart.catalog import ORACLES, QUERIES
from loanmart.fixtures import BASE_TABLES, FIXTURES, Tables
from tools.check_queries import compare, plain, sort_key



@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.sql(f"create view {name} as select * from '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(FIXTURES))
def test_fixture_is_the_same_in_both_engines(spark, data, con, name):
    df = getattr(Tables(spark, data), name)
    names = {n: n for n in (*BASE_TABLES, *FIXTURES)}
    for key, text in FIXTURES.items():
        con.sql(f"create or replace view {key} as {text.format(**names)}")
    got = sorted((tuple(map(str, r)) for r in df.collect()))
    want = sorted((tuple(map(str, r)) for r in con.sql(f"select * from {name}").fetchall()))
    assert got == want and got


@pytest.mark.parametrize("key", [k for k in QUERIES if k in ORACLES])
def test_query_matches_sql(spark, data, con, key):
    df = QUERIES[key](spark, data)
    assert compare(df.collect(), df.columns, con, ORACLES[key]) == "ok"


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["loan_id", "customer_id", "loan_start_date", "label", "label_def", "snapshot_date"]
    assert df.count() > 0


def test_compare_helpers():
    assert plain(-0.0) == "negative zero" and plain(float("nan")) == "nan"
    assert sorted([(None,), (1,)], key=sort_key)[0] == (1,)
