"""Every catalog query against DuckDB on the same tables, and the entry point."""

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from plumbline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<bigint>": "BIGINT[]"}
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    rel = duck.sql(catalog.SQL[name])
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_point(spark):
    assert __spark_entry__.entry(spark).columns[:2] == ["dataset_name", "subset"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "plumbline").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                names = [getattr(node, "module", None) or "", *(a.name for a in node.names)]
                assert not any("llm" in n.split(".") for n in names), path
