"""Every registered query against DuckDB on the same tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry
from tests.conftest import TESTDATA

SF_DIR = os.environ.get("FARELENS_SF_DIR", TESTDATA)
# The corpus queries, where present, have tests of their own.
CORPUS = registry.llm_queries.queries().keys() if registry.llm_queries else set()
QUERIES = {name: query for name, query in registry.queries().items() if name not in CORPUS}
ORACLE = {name: sql for name, sql in registry.oracle_sql().items() if name not in CORPUS}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


# Sketches draw at random; tests/test_daily.py holds them against exact ranks.
WITHOUT_SQL = {"trip_duration_sketch"}


def test_every_query_has_sql():
    assert QUERIES.keys() - WITHOUT_SQL == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - WITHOUT_SQL))
def test_matches_duckdb(spark, duck, name):
    report = QUERIES[name](spark, SF_DIR)
    expected = duck.sql(ORACLE[name])
    columns = sorted(report.columns)
    assert columns == sorted(expected.columns)
    got = sorted((tuple(r[c] for c in columns) for r in report.collect()), key=repr)
    at = [expected.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=repr)
    assert got == want
    if name != "dq_outliers":  # fares are spread evenly in the test tables
        assert got


def test_entry(spark):
    report = registry.entry(spark)
    assert report.columns[:2] == ["date", "trip_count"]
    assert report.count() > 0
