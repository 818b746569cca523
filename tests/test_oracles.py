"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quire.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(repr(round(float(v), 9)) if isinstance(v, float) else repr(v) for v in (r[i] for i in order)) for r in values])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    want = db.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0
