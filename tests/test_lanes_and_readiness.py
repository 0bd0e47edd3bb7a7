"""Lanes side by side, readiness from the pass that writes, and answers of any size."""

import time

import pytest
from fakes import NumbersFactory, SlowDocuments

from vectorloom.operators.quality import readiness, status_rollup, status_totals
from vectorloom.plans.bulk import embed_large_requests, embed_requests
from vectorloom.schemas import REQUEST, REQUEST_TEXT
from vectorloom.streaming.jobs import (
    READINESS,
    ReadinessListener,
    embed_lanes,
    embed_stream,
    embed_stream_with_dead_letters,
    read_request_stream,
)


def _put(spark, path, rows, files=1):
    spark.createDataFrame(rows, REQUEST).repartition(files).write.mode("append").parquet(path)


def test_documents_do_not_hold_back_queries(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    cores = spark.sparkContext.defaultParallelism
    _put(spark, source, [(i, "gemma", "document", [f"d{i}"], 2) for i in range(cores * 10)], cores * 10)
    _put(spark, source, [(1000 + i, "gemma", ("query", "bogus")[i % 2], ["q"], 2) for i in range(6)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4194304")  # a task per file, by the cost of opening one
    try:
        lanes = embed_lanes(read_request_stream(spark, source), out, cp, factory=SlowDocuments(), once_within=None)
        lanes["query"].awaitTermination()
        assert lanes["document"].isActive  # queries are answered while documents still run
        lanes["document"].awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    queries = spark.read.parquet(f"{out}/query/outcomes").collect()
    assert sorted((r.request_id, r.status) for r in queries) == [(1000, 200), (1002, 200), (1004, 200)]
    rest = {r.request_id: r.status for r in spark.read.parquet(f"{out}/document/outcomes").collect()}
    assert rest == {i: 200 for i in range(cores * 10)} | {1001: 404, 1003: 404, 1005: 404}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_observed_counts_give_the_rollup(spark):
    schema = "model string, status int, kind string"
    rows = [("gemma", 200, None), ("gemma", 500, "exception"), ("qwen", 503, "unavailable"), ("qwen", 503, "rejected"), ("x", 404, None)]
    for some in (rows, rows[:2], rows[3:], []):
        frame = spark.createDataFrame(some, schema)
        totals = frame.agg(*status_totals()).first().asDict()
        rolled = [(r.model, r.n_ok, r.n_failed, r.status) for r in status_rollup(frame).collect()]
        assert sorted(tuple(r.values()) for r in readiness(totals)) == sorted(rolled)
    assert [r["model"] for r in readiness(spark.createDataFrame([], schema).agg(*status_totals("qwen")).first().asDict(), "qwen")] == ["qwen"]


def test_readiness_per_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for number, word in enumerate(["1", "loading", "gone", "1"]):
        _put(spark, source, [(number, "qwen", "query", [word], 2), (10 + number, "gemma", "query", ["1"], 2)])
        stream = read_request_stream(spark, source)
        embed_stream_with_dead_letters(stream, out, str(tmp_path / "cp"), factory=NumbersFactory(), once_within=None).awaitTermination()
    rows = spark.read.parquet(f"{out}/readiness").collect()
    assert sorted((r.batch_id, r.model, r.n_ok, r.n_failed, r.status) for r in rows) == sorted(
        [(b, "gemma", 1, 0, "ok") for b in range(4)]
        + [(0, "qwen", 1, 0, "ok"), (1, "qwen", 0, 1, "loading"), (2, "qwen", 0, 1, "unreachable"), (3, "qwen", 1, 0, "ok")]
    )


def test_a_listener_reports_a_stream_of_vectors(spark, tmp_path):
    told = []
    listener = ReadinessListener(lambda name, batch, rows: told.append((batch, {r["model"]: r["status"] for r in rows})), active="qwen,gemma")
    source = str(tmp_path / "in")
    rows = [(i, ("gemma", "qwen")[i % 2], "query", 2, 0, "gone" if i == 3 else "1") for i in range(6)]
    spark.createDataFrame(rows, REQUEST_TEXT).write.parquet(source)
    spark.streams.addListener(listener)
    try:
        stream = read_request_stream(spark, source, REQUEST_TEXT)
        query = embed_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), factory=NumbersFactory(), active="qwen,gemma", once_within=None)
        query.awaitTermination()
        assert READINESS in query.lastProgress.observedMetrics
        for _ in range(100):
            if told:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told[0] == (0, {"qwen": "unreachable", "gemma": "ok"})
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 6 and "status" not in written.columns and "kind" not in written.columns


ROWS = [
    (1, "gemma", "query", ["1", "2"], 2), (2, "gemma", "query", [str(k) for k in range(40)], 2),
    (2, "gemma", "query", ["7"] * 41, 2), (None, "qwen", "query", ["5"] * 42, 2), (3, "gemma", "query", ["1"] * 39 + ["refused"], 2),
    (4, "bogus", "query", ["1"] * 50, 2), (5, "gemma", "query", ["1"] * 40 + [None], 2), (6, "gemma", "query", [], 2),
]
SMALL = 32 * 2 * 8


def test_large_requests_in_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "n int, request_id long, model string, task string, payloads array<string>, dimensions long").write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = read_request_stream(spark, source, schema)
    embed_stream_with_dead_letters(
        stream, out, str(tmp_path / "cp"), keys=("n", "request_id"), factory=NumbersFactory(), row_bytes=SMALL, normalize=False
    ).awaitTermination()
    outcomes = {r.n: (r.status, r.kind, None if r.embeddings is None else len(r.embeddings)) for r in spark.read.parquet(f"{out}/outcomes").collect()}
    assert outcomes == {
        0: (200, None, 2), 1: (200, None, None), 2: (200, None, None), 3: (200, None, None), 4: (500, "rejected", None),
        5: (404, None, None), 6: (422, None, None), 7: (200, None, 0),
    }
    parts = {r.n: r for r in spark.read.parquet(f"{out}/response_parts").collect()}
    assert {n: [v[0] for v in r.embeddings] for n, r in parts.items()} == {1: list(range(40)), 2: [7] * 41, 3: [5] * 42}
    assert parts[3].request_id is None
    letters = {r.n: r.status for r in spark.read.parquet(f"{out}/dead_letters").collect()}
    assert letters == {4: 500, 5: 404, 6: 422}
    ready = {r.model: (r.n_ok, r.n_failed, r.status) for r in spark.read.parquet(f"{out}/readiness").collect()}
    assert ready == {"gemma": (4, 1, "ok"), "qwen": (1, 0, "ok")}


def test_large_requests_of_a_table(spark):
    requests = spark.createDataFrame(ROWS, REQUEST)
    usual = embed_requests(requests, factory=NumbersFactory(), row_bytes=SMALL).collect()
    assert sorted(r.request_id or 0 for r in usual if r.kind == "large") == [0, 2, 2, 3]
    outcomes, parts = embed_large_requests(requests, factory=NumbersFactory(), part_texts=16, normalize=False)
    assert outcomes.columns == embed_requests(requests, factory=NumbersFactory()).columns
    assert [r.part for r in parts.where("request_id is null").orderBy("part").collect()] == [0, 1, 2]
    whole = embed_requests(requests, factory=NumbersFactory(), normalize=False).collect()

    def shown(rows):
        return sorted(repr((r.request_id, r.model, r.task, r.build, r.dimensions, r.status, r.detail, r.kind)) for r in rows)

    assert shown(outcomes.collect()) == shown(whole)
    outcomes, parts = embed_large_requests(requests.limit(0), factory=NumbersFactory())
    assert outcomes.count() == 0 and parts.count() == 0


def test_lanes_need_fair_sharing(spark, tmp_path, monkeypatch):
    from pyspark import SparkConf

    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: SparkConf(loadDefaults=False))
    with pytest.raises(ValueError):
        embed_lanes(read_request_stream(spark, str(tmp_path)), "out", "cp")
