"""Every core query runs, and equals its SQL, on the smallest tables; the core stands without the llm subpackage."""

from __future__ import annotations

import ast
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from lanternfish.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in ORACLES:
        want = sql.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        assert got == sorted(tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_nothing_else_imports_llm():
    for path in [*ROOT.glob("lanternfish/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), path


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
