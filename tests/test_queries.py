"""Every catalogue query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from auditloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(rows, columns):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for _, v in sorted(zip(columns, r, strict=True))]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    wanted = tables.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert plain(df.collect(), df.columns) == plain(wanted.fetchall(), wanted.columns)


def test_entry_without_the_training_data_subpackage(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith(("auditloom.llm", "corpus_pipeline")) else real(n, *a))
    assert importlib.reload(entry) and not any(n.startswith(("op", "pipeline")) for n in entry.queries())
    monkeypatch.undo()
    importlib.reload(entry)
