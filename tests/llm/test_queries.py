"""Every query runs on the smallest tables, and equals its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from lanternfish.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {"p1_found": "id license_id", "p3_found": "id_a id_b", "p4_found": "id_a id_b", "p5_found": "id_a id_b", "p6_found": "id", "p7_found": "id term", "p8_ids": "doc_id ids", "p10_found": "doc_id"}


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(map(str, rows))) == len(rows)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
    if name in ORACLES:
        plain = lambda r: tuple(round(x, 6) if isinstance(x, float) and not math.isnan(x) else x for x in r)
        want = sql.sql(ORACLES[name])
        assert sorted(map(plain, (r[: len(df.columns)] for r in df.select(*want.columns).collect()))) == sorted(map(plain, want.fetchall()))
