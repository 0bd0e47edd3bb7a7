import tracemalloc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pytest
from fakes import FixedFactory, Numbers, NumbersFactory, ShortFactory
from pyspark.sql import functions as F

from vectorloom.encoders import EncoderRejected, HashingFactory
from vectorloom.functions import classify_failure
from vectorloom.operators import embedding
from vectorloom.plans.faults import FaultyFactory
from vectorloom.operators.embedding import _calls, _encode_in_chunks, _isolate, encode_requests

SOME = [str(i) for i in range(3, 30)]
SCHEMA = "id int, model string, task string, texts array<string>, dimensions int"


def _run(spark, rows, factory=NumbersFactory(), **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = encode_requests(df, factory, ["id", "model"], normalize=options.pop("normalize", False), **options)
    error = classify_failure(F.col("outcome"), F.col("model"))
    return {r.id: r for r in out.withColumn("error", error).collect()}


def test_chunks_keep_order_and_size():
    encoder = Numbers()
    vectors = _encode_in_chunks(encoder, SOME, 8, 9)
    assert encoder.sizes == [8, 8, 8, 3]
    assert vectors.tolist() == [[float(t), 1.0] for t in SOME]
    whole = Numbers()
    assert _encode_in_chunks(whole, SOME, 256, 1).tolist() == [[float(t)] for t in SOME]
    assert whole.sizes == [27] and _encode_in_chunks(whole, [], 8, 9).shape == (0, 0)


def test_first_failing_chunk_decides_the_error():
    texts = [*SOME[:10], "loading", "gone", *SOME[10:]]
    with pytest.raises(EncoderRejected) as caught:
        _encode_in_chunks(Numbers(), texts, 8, 9)
    assert caught.value.code == 503


def test_isolation_spares_neighbours():
    requests = [[str(i)] for i in range(300)]
    requests[17], requests[170] = ["1", "refused", "2"], ["gone"]
    encoder = Numbers()
    results = _isolate(encoder, requests, 256, 2)
    bad = [i for i, r in enumerate(results) if isinstance(r, Exception)]
    assert bad == [17, 170]
    assert all(results[i].tolist() == [[float(i), 1.0]] for i in range(300) if i not in bad)
    assert len(encoder.sizes) < 50


def test_calls_are_lane_pure_whole_and_in_order():
    lanes = [("m", "document"), ("m", "query")] * 40
    sizes = [(i * 7) % 11 for i in range(80)]
    calls = list(_calls(lanes, sizes, 32))
    assert sorted(r for c in calls for r in c) == list(range(80))
    for call in calls:
        assert len({lanes[r] for r in call}) == 1 and call == sorted(call)
        assert sum(sizes[r] for r in call[:-1]) < 32
    large = list(_calls([("m", "query")] * 3, [1, 300, 1], 256))
    assert large == [[1], [0, 2]]
    lone = list(_calls([("m", "query")] * 3, [300, 1, None], 256))
    assert lone == [[0], [1], [2]]


def test_requests_and_failures(spark):
    rows = [
        (1, "gemma", "document", SOME, 2),
        (2, "gemma", "query", ["3", "loading", "gone"], 2),
        (3, "gemma", "query", ["gone"], 2),
        (4, "qwen", "document", ["refused"], 2),
        (5, "qwen", "query", ["untokenizable"], 2),
        (6, "qwen", "query", ["broken"], 2),
        (7, "qwen", "query", [], 2),
        (8, "qwen", "query", None, 2),
        (9, "qwen", "query", ["5"], 1),
    ]
    got = _run(spark, rows)
    assert [v[0] for v in got[1].embeddings] == [float(t) for t in SOME] and got[1].error is None
    errors = {i: tuple(got[i].error)[:2] for i in (2, 3, 4, 5, 6)}
    assert [got[i].error.kind for i in (2, 3, 4, 5, 6)] == ["rejected", "unavailable", "rejected", "tokenize", "exception"]
    assert errors == {
        2: (503, "gemma: loading"),
        3: (503, "gemma model server unavailable: no route"),
        4: (500, "qwen: refused"),
        5: (500, "qwen: tokenize failed: bad bytes"),
        6: (500, "'broken'"),
    }
    assert all(got[i].embeddings is None for i in (2, 3, 4, 5, 6, 8))
    assert got[7].embeddings == [] and got[7].outcome.kind == "ok"
    assert got[8].outcome is None and got[8].error is None
    assert got[9].embeddings == [[5.0]]


def test_each_request_has_its_own_width(spark):
    rows = [(d, "qwen", "query", ["a", "b"], d) for d in (1, 2, 3, 4, 5, 99)]
    got = _run(spark, rows, FixedFactory((3.0, 4.0, 12.0, 84.0)), normalize=True, double=True)
    for d, row in got.items():
        v = np.array([3.0, 4.0, 12.0, 84.0][:d])
        np.testing.assert_allclose(row.embeddings, [v / np.linalg.norm(v)] * 2, atol=1e-12)


def test_a_lost_vector_fails_the_request(spark):
    got = _run(spark, [(1, "gemma", "query", ["a", "b"], 2)], ShortFactory())
    assert got[1].error.status == 500 and "1 vectors for 2 texts" in got[1].error.detail


def test_a_request_too_large_for_a_row_is_refused_before_it_is_encoded(monkeypatch):
    encoder = Numbers()
    monkeypatch.setattr(embedding, "ROW_BYTES", 100)
    monkeypatch.setattr(embedding, "load_encoder", lambda factory, model: encoder)
    texts = pa.chunked_array([pa.array([[str(i) for i in range(20)]])])
    (result,) = embedding._call(None, "m", texts, [2], 8, np.float32, {})
    assert isinstance(result, ValueError) and encoder.sizes == []
    (result,) = embedding._call(None, "m", texts, [1], 8, np.float32, {})
    assert result.shape == (20, 1)


@dataclass(frozen=True)
class WideFactory:
    def __call__(self, model):
        return self

    def encode(self, texts):
        return np.ones((len(texts), 4096), np.float32)


def test_a_large_request_is_held_at_its_own_width():
    tracemalloc.start()
    texts = pa.chunked_array([pa.array([["x"] * 100_000])])
    (result,) = embedding._call(WideFactory(), "qwen", texts, [8], 256, np.float32, {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert result.shape == (100_000, 8) and peak < 60e6


def test_a_model_that_does_not_load_fails_its_own_requests(spark):
    factory = FaultyFactory(NumbersFactory(), missing=("qwen",))
    rows = [(i, ("gemma", "qwen")[i % 2], ("query", "document")[i % 3 % 2], [str(i)], 2) for i in range(12)]
    got = _run(spark, rows, factory)
    assert {i: r.error and tuple(r.error) for i, r in got.items()} == {
        i: (503, "qwen model server unavailable: weights missing", "unavailable") if i % 2 else None for i in range(12)
    }
    assert all(got[i].embeddings == [[float(i), 1.0]] for i in range(0, 12, 2))


def test_hashing_encoder_values():
    encoder = HashingFactory((("m", 768),))("m")
    a, empty, twice = encoder.encode(["abc", " ", "abc x abc"])
    h = 2416005272
    assert a[(h >> 1) % 768] == (1 if h & 1 else -1) and np.abs(a).sum() == 1
    assert not empty.any()
    assert abs(twice[(h >> 1) % 768]) >= 1 and twice.sum() in (-3, -1, 1, 3)


def test_result_does_not_depend_on_partitions_or_batches(spark):
    rows = [(i, "gemma", ("query", "document")[i % 2], [str(i), str(i + 1)], 2) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = set()
    for parts, arrow, call, chunk in ((1, 10000, 256, 8), (5, 3, 7, 3), (16, 1, 1, 1), (2, 50, 30, 8)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
        try:
            out = encode_requests(df.repartition(parts), NumbersFactory(), ["id"], call_texts=call, chunk_texts=chunk)
            seen.add(tuple(sorted((r.id, str(r.embeddings)) for r in out.collect())))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(seen) == 1 and len(next(iter(seen))) == 200
