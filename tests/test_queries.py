"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from weftline import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted([value(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    got = plans.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    want = db.sql(plans.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.columns, rows) == canonical(want.columns, want.fetchall())
