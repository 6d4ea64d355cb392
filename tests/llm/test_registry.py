"""Queries with SQL against DuckDB; every operator is registered once."""

import importlib

import pytest

import __spark_entry__ as entry
from linescan.llm import registry
from tests.test_queries import connected, plain


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = connected(small).sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_names():
    names = entry.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in names and importlib.import_module("corpus_pipeline").run is names["pipeline"]
