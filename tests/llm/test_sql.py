"""The corpus queries that have SQL equal it on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lattica.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cell(v):
    if v is None or v != v:
        return ""
    return f"{float(v):.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == columns
    theirs = want.select(*columns).fetchall()
    assert theirs and sorted(tuple(map(cell, r)) for r in found.select(*columns).collect()) == sorted(tuple(map(cell, r)) for r in theirs)
