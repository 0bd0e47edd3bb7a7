"""Every registered query against its SQL, and the shape of its plan."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from vectorloom.plans.oracles import ORACLE_SQL
from vectorloom.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql(small):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return connection


def _plain(value):
    return float(value) if hasattr(value, "as_integer_ratio") and not isinstance(value, bool) else value


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE_SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, small, sql, name):
    frame = entry_points.queries()[name](spark, small)
    relation = sql.sql(entry_points.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    mine = [tuple(map(_plain, r)) for r in frame.select(*sorted(frame.columns)).collect()]
    order = [relation.columns.index(c) for c in sorted(relation.columns)]
    theirs = [tuple(_plain(r[i]) for i in order) for r in relation.fetchall()]
    assert len(mine) > 0 and sorted(map(repr, mine)) == sorted(map(repr, theirs))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan)


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["doc_id", "nnz", "chk"] and frame.count() == 200


def test_bulk_embedding_does_not_shuffle(spark, tmp_path):
    from vectorloom.plans.bulk import embed, embed_requests
    from vectorloom.schemas import REQUEST

    path = str(tmp_path / "docs")
    spark.range(64).selectExpr("id", "'a b' as text", "'x' as wide").repartition(16).write.parquet(path)
    plan = embed(spark.read.parquet(path), "text", "gemma", "document", 8, keys=["id"])
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shown and "struct<id:bigint,text:string>" in shown
    requests = embed_requests(spark.read.schema(REQUEST).parquet(path))
    shown = requests._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange") == shown.count("BroadcastExchange") and shown.count("FileScan") == 1


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("name", ["stream_embed", "stream_dead_letters", "stream_readiness", "stream_lanes"])
def test_streams_read_a_table_of_any_number_of_files(spark, tmp_path, name, files):
    from vectorloom.streaming.jobs import read_request_stream

    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(i // 3, i % 3, ("user", "assistant")[i % 2], f"words of turn {i} " * (i % 4 + 1)) for i in range(60)]
    folder = tmp_path / "conversations.parquet"
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(str(folder))
    parts = str(folder / "*.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{parts}'")
    frame = QUERIES[name](spark, str(tmp_path))
    relation = connection.sql(ORACLE_SQL[name])
    mine = [tuple(map(_plain, r)) for r in frame.select(*sorted(frame.columns)).collect()]
    order = [relation.columns.index(c) for c in sorted(relation.columns)]
    theirs = [tuple(_plain(r[i]) for i in order) for r in relation.fetchall()]
    assert len(mine) > 0 and sorted(map(repr, mine)) == sorted(map(repr, theirs))
    one = next(folder.glob("*.parquet"))
    assert read_request_stream(spark, str(one), schema).isStreaming
