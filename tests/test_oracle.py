"""Every registered query against its DuckDB oracle on the same parquet tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import rows_of
from gatemeter.sources.tables import TABLES

from conftest import SF_SMALL

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "session_id" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    assert name in QUERIES
    got_cols, got = rows_of(QUERIES[name](spark, SF_SMALL).toPandas())
    want_cols, want = rows_of(con.execute(ORACLES[name]).df())
    assert got_cols == want_cols
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
