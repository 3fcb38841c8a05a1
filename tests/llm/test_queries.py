"""Every query of the package runs on the smallest tables and gives what TESTDATA.md says of its columns."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from corvane.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "p2_found": ["source_id", "seg_no", "lang"],
    "p3_found": ["source_id_a", "source_id_b"],
    "p4_found": ["item_kind", "item_id", "case_kind"],
    "p5_found": ["source_id_a", "source_id_b"],
    "p6_found": ["source_id", "pii_kind", "start_pos"],
    "p7_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, name):
    found = QUERIES[name](spark, small)
    rows = found.collect()
    assert rows
    if name in COLUMNS:
        assert found.columns == COLUMNS[name]
        if name != "p7_ids":
            assert len(rows) == len(set(rows))
        if name.endswith("_a"):
            assert all(r[0] < r[1] for r in rows)


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, small, name):
    with duckdb.connect() as connection:
        for p in Path(small).glob("*.parquet"):
            connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        expected = connection.sql(ORACLES[name])
        found = QUERIES[name](spark, small).select(*expected.columns)
        assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())
