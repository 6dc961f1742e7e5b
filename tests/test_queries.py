"""Every registered query against its SQL on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from suite.queries import QUERIES as ENGINE_QUERIES

SQL = entry.oracle_sql()
QUERIES = {name: fn for name, fn in entry.queries().items() if name in ENGINE_QUERIES}


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return connection


def test_every_query_of_the_engine_has_sql():
    assert set(SQL) >= set(ENGINE_QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    ours = QUERIES[name](spark, sf_dir)
    columns = sorted(ours.columns)
    theirs = duck.execute(SQL[name])
    found = [d[0] for d in theirs.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    expected = sorted((tuple(row[i] for i in order) for row in theirs.fetchall()), key=repr)
    rows = sorted((tuple(row) for row in ours.select(*columns).collect()), key=repr)
    assert rows and rows == expected


def test_entry_has_a_stable_schema(spark):
    rows = entry.entry(spark)
    assert rows.columns == [
        "query_id", "rank", "chunk_id", "file_path", "file_name", "content_type", "language", "content", "score",
    ]
    assert rows.schema == entry.entry(spark).schema


def test_the_engine_works_without_the_training_queries(monkeypatch, capsys):
    """An import that fails below the training operators leaves the other queries alone."""
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "lodestone.llm", None)
    try:
        again = importlib.reload(entry)
        assert set(again.queries()) == set(ENGINE_QUERIES) and "left out" in capsys.readouterr().err
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
