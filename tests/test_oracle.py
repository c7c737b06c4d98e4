"""Every query against its DuckDB SQL."""

from __future__ import annotations

import pytest
from conftest import oracle_rows, rows_of

from millrace.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def test_only_approximate_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"cells_topk"}  # its recall is a query with SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names, want = oracle_rows(duck, ORACLES[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_entry(spark, sf):
    assert catalog.entry(spark, sf).count() > 0


def test_registry_without_corpus_operators(monkeypatch):
    """The entry module imports, and the other queries are there, when the corpus operators are gone."""
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("millrace.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
