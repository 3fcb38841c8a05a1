"""Every query runs on the smallest tables, and those with SQL give the same rows as it."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
CORE = [n for n in QUERIES if QUERIES[n].__module__.startswith("corvane.plans")]


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


@pytest.mark.parametrize("name", CORE)
def test_query(spark, small, duck, name):
    found = QUERIES[name](spark, small)
    columns = sorted(found.columns)
    rows = sorted(repr([r[c] for c in columns]) for r in found.collect())
    if name in ORACLES:
        expected = duck.sql(ORACLES[name])
        assert sorted(expected.columns) == columns
        at = [expected.columns.index(c) for c in columns]
        assert rows == sorted(repr([r[i] for i in at]) for r in expected.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
