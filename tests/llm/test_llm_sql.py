"""Every registered query of the optional part that SQL can express, against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from vectorloom.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_sql(spark, small, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    frame = QUERIES[name](spark, small)
    relation = connection.sql(ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    mine = sorted(map(repr, map(tuple, frame.select(*sorted(frame.columns)).collect())))
    order = [relation.columns.index(c) for c in sorted(relation.columns)]
    assert mine and mine == sorted(repr(tuple(r[i] for i in order)) for r in relation.fetchall())


def test_one_query_per_operator():
    names = list(entry_points.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names


def test_operators_11_to_13_have_one_query_each():
    names = list(entry_points.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(11, 14)] == [1] * 3
