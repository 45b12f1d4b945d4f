"""Registered queries: each against its SQL on the smallest scale."""

import os

import duckdb
import pytest

from starweave.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, FOLDER)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at, to = [df.columns.index(c) for c in sorted(df.columns)], [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(tuple(norm(r[i]) for i in at) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in to) for r in want.fetchall())


def test_explain_runs_over_the_catalog(spark):
    rows = catalog.run(spark, FOLDER, "explain", ["Q01", "Q21", "obt_encounter"]).collect()
    assert {r.status for r in rows} == {"SUCCEEDED"}
