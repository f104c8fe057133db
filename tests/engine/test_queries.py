"""Each query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

from corvane.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings labels benchmark pages conversations events orders lineitem customer".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda rs, cs: sorted(repr(tuple(plain(r[cs.index(c)]) for c in columns)) for r in rs)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


def test_entry_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "recall_at_k" in entry.queries() and not [n for n in entry.queries() if n.startswith("op")]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    sys.modules.pop("__spark_entry__", None)
