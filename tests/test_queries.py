"""Every query with SQL equals it on the smallest tables; the others return rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from lattica import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NA or v != v:
        return None
    return f"{float(v):.9g}" if isinstance(v, float) else str(v)


def rows(frame, columns):
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)) if len(frame) else []


def key(row):
    return tuple("" if v is None else v for v in row)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, SF)
    if name not in plans.ORACLE_SQL:
        assert found.count() > 0
        return
    got, want = found.toPandas(), duck.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    mine = [tuple(cell(v) for v in r) for r in got[columns].astype(object).itertuples(index=False)]
    theirs = [tuple(cell(v) for v in r) for r in want[columns].astype(object).itertuples(index=False)]
    assert sorted(mine, key=key) == sorted(theirs, key=key)
