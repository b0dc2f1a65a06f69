"""Registered queries of the training-data operators against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from weftline.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, r)) for r in got.select(columns).collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
