import math

import pytest
from fakes import CharacterFactory, NumbersFactory
from pyspark.sql import functions as F

from vectorloom.operators import requests as request_operators
from vectorloom.operators.requests import (
    SLICE_ROWS,
    first_failures,
    regroup_responses,
    request_rows,
    split_by_size,
    validate_request_texts,
    validate_requests,
)
from vectorloom.plans.bulk import embed, embed_request_texts, embed_requests, encode_request_texts
from vectorloom.schemas import REQUEST, REQUEST_TEXT
from vectorloom.session import materialize
from vectorloom.sources.sinks import write_response_parts

RIVER = "the river ran past mill and meadow " * 900
NOTES = ["Bread needs time.", "Tides follow the moon; ships follow tides.", "", "A loose bolt rattles."]


def _requests(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REQUEST)


@pytest.mark.parametrize("model,native", [("gemma", 768), ("qwen", 4096)])
def test_widths_and_lengths_of_answers(spark, model, native):
    asked = {1: 1, 100: 100, None: 768, native: native, 10_000: native}
    rows = [
        (model, task, payloads, width)
        for task in ("document", "query")
        for payloads in (NOTES, [RIVER, NOTES[0]], ["tea?"])
        for width in asked
    ]
    got = {r.request_id: r for r in embed_requests(_requests(spark, rows)).collect()}
    for i, (_, _, payloads, width) in enumerate(rows):
        assert (got[i].status, got[i].detail, got[i].dimensions) == (200, None, asked[width])
        assert [len(v) for v in got[i].embeddings] == [asked[width]] * len(payloads)
        lengths = [math.sqrt(sum(x * x for x in v)) for v in got[i].embeddings]
        assert all(n == 0 or abs(n - 1) < 1e-5 for n in lengths)


def test_statuses_and_their_order(spark):
    ok = ["x"]
    cases = [
        (("bogus", "query", ok, None), 404, "Unknown model 'bogus'; available: gemma, qwen"),
        (("bogus", "document", [], None), 404, "Unknown model 'bogus'; available: gemma, qwen"),
        ((None, "query", ok, None), 404, "Not Found"),
        (("", "query", None, 0), 404, "Not Found"),
        (("gemma", "search", ok, None), 404, "Not Found"),
        (("gemma", None, ok, 0), 404, "Not Found"),
        (("Gemma", "query", ok, None), 404, "Unknown model 'Gemma'; available: gemma, qwen"),
        (("it's", "query", ok, None), 404, "Unknown model \"it's\"; available: gemma, qwen"),
        (("bogus", "query", ok, 0), 422, "dimensions: input should be greater than or equal to 1"),
        (("gemma", "query", ok, -3), 422, "dimensions: input should be greater than or equal to 1"),
        (("bogus", "query", None, None), 422, "payloads: input should be a valid list"),
        (("gemma", "query", ["a", None], 0), 422, "payloads: every item should be a valid string"),
        (("gemma", "query", [], None), 200, None),
        (("gemma", "query", [""], 1), 200, None),
    ]
    frame = _requests(spark, [c[0] for c in cases])
    got = {r.request_id: r for r in embed_requests(frame).collect()}
    assert [(got[i].status, got[i].detail) for i in range(len(cases))] == [c[1:] for c in cases]
    assert got[12].embeddings == [] and got[0].embeddings is None


def test_known_but_inactive_model_is_404(spark):
    frame = _requests(spark, [("qwen", "query", ["x"], None), ("gemma", "query", ["x"], None)])
    got = {r.request_id: r for r in embed_requests(frame, active="gemma").collect()}
    assert (got[0].status, got[0].detail) == (404, "Unknown model 'qwen'; available: gemma")
    assert got[1].status == 200


def test_default_width_is_set(spark):
    asked = [("qwen", None), ("qwen", 7), ("qwen", 5000), ("gemma", 5000), ("gemma", 10**12)]
    frame = _requests(spark, [(m, "query", ["x"], d) for m, d in asked])
    got = [r.dimensions for r in validate_requests(frame).orderBy("request_id").collect()]
    assert got == [768, 7, 4096, 768, 768]


def _long(spark, rows):
    return spark.createDataFrame(rows, REQUEST_TEXT)


def test_long_form_agrees_with_array_form(spark):
    rows = [
        ("gemma", "query", [f"text {i} {j}" for j in range(i % 4 + 1)], (None, 16, 0)[i % 3]) for i in range(12)
    ] + [
        ("bogus", "query", ["x", "y"], None), ("gemma", "document", ["a", None], None), ("bogus", "query", [None], 0),
        ("gemma", "query", [], None), ("qwen", "document", None, 5), ("bogus", "query", [], None), ("gemma", "query", [], 0),
        ("gemma", "unknown", None, None),
    ]
    frame = _requests(spark, rows)
    array_form = {r.request_id: r for r in embed_requests(frame).collect()}
    long_form = request_rows(frame).select(*[f.name for f in REQUEST_TEXT.fields])
    failures, vectors = embed_request_texts(long_form)
    failed = {r.request_id: (r.status, r.detail) for r in failures.collect()}
    assert failed == {i: (r.status, r.detail) for i, r in array_form.items() if r.status != 200}
    grouped = {r.request_id: r.embeddings for r in regroup_responses(vectors).collect()}
    assert grouped == {i: r.embeddings for i, r in array_form.items() if r.status == 200}
    heads = {r.request_id: r.error for r in validate_request_texts(long_form).collect()}
    assert {i: tuple(e)[:2] for i, e in heads.items() if e} == failed and set(heads) == set(array_form)


def test_one_request_holding_most_rows(spark, monkeypatch):
    """A request over several slices fails as a whole; one that does not keeps every vector."""
    n = 2 * SLICE_ROWS + 10

    def rows(request, bad_at):
        return [(request, "gemma", "query", 2, j, "refused" if j == bad_at else str(j)) for j in range(n)]

    data = rows(1, n - 1) + rows(2, None) + [(3, "gemma", "query", 2, 0, "7"), (4, "gemma", "query", 2, 0, "gone")]
    frame = _long(spark, data).repartition(8)
    encoded = materialize(encode_request_texts(frame, factory=NumbersFactory(), normalize=False), "test")
    failures, vectors = first_failures(encoded)
    assert sorted((r.request_id, r.status) for r in failures.collect()) == [(1, 500), (4, 503)]
    counts = {r.request_id: r.n for r in vectors.groupBy("request_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {2: n, 3: 1}
    # The same without broadcasting the failed requests.
    monkeypatch.setattr(request_operators, "FEW_REQUESTS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        failures, vectors = first_failures(encoded)
        assert "Broadcast" not in vectors._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.request_id, r.status) for r in failures.collect()) == [(1, 500), (4, 503)]
        assert vectors.count() == n + 1 and vectors.where("request_id in (1, 4)").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    parts = regroup_responses(vectors.where("request_id = 2"), part_texts=1000).orderBy("part").collect()
    assert [p.part for p in parts] == list(range(n // 1000 + 1))
    assert [v[0] for p in parts for v in p.embeddings] == [float(j) for j in range(n)]


def test_first_error_of_a_request_wins(spark):
    data = [
        (1, "gemma", "query", 2, 0, "1"), (1, "gemma", "query", 2, 1, "loading"), (1, "gemma", "query", 2, 2, "refused"),
        (2, "gemma", "query", 2, 0, "refused"), (2, "gemma", "query", 2, 1, "gone"),
        (3, "gemma", "query", 2, 0, "refused"), (3, "gemma", "query", 2, 1, None),
    ]
    failures, vectors = embed_request_texts(_long(spark, data), factory=NumbersFactory())
    assert {r.request_id: (r.status, r.detail) for r in failures.collect()} == {
        1: (503, "gemma: loading"),
        2: (500, "gemma: refused"),
        3: (422, "payloads: every item should be a valid string"),
    }
    assert vectors.count() == 0


def test_request_rows_number_payloads(spark):
    rows = [("gemma", "query", ["b", "a", "c"], None), ("gemma", "query", [], None), ("gemma", "query", None, None)]
    got = [(r.request_id, r.payload_index, r.payload) for r in request_rows(_requests(spark, rows)).collect()]
    assert got == [(0, 0, "b"), (0, 1, "a"), (0, 2, "c"), (1, -1, None), (2, -2, None)]


def test_large_requests_take_the_long_form(spark, tmp_path):
    rows = [("gemma", "query", ["a"] * 10, 4), ("gemma", "query", ["a", "b", "c"], 4), ("gemma", "query", [], 4), ("gemma", "query", None, 4)]
    usual, large = split_by_size(_requests(spark, rows), 200)
    assert sorted(r.request_id for r in usual.collect()) == [1, 2, 3]
    failures, vectors = embed_request_texts(large)
    write_response_parts(vectors, str(tmp_path / "answers"), part_texts=4)
    answers = spark.read.json(str(tmp_path / "answers")).orderBy("part").collect()
    assert [(r.request_id, r.part, len(r.embeddings)) for r in answers] == [(0, 0, 4), (0, 1, 4), (0, 2, 2)]
    assert failures.count() == 0


def test_embed_arguments(spark):
    texts = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    for bad in (("bert", "query", 3), ("gemma", "search", 3), ("gemma", "query", 0)):
        with pytest.raises(ValueError):
            embed(texts, "text", *bad)
    got = {r.id: r for r in embed(texts, "text", "gemma", "query", 5).collect()}
    assert len(got[1].embedding) == 5 and got[1].outcome.kind == "ok"
    assert got[2].embedding is None and got[2].outcome.kind == "missing"


def test_encoder_with_its_own_tokenizer(spark):
    """Whole texts arrive, are cut by their own tokens, and white space is left alone."""
    texts = spark.createDataFrame([(1, "a  b"), (2, "x" * 50 + "y"), (3, "\x00")], "id long, text string")
    got = {r.id: r for r in embed(texts, "text", "qwen", "document", 9, factory=CharacterFactory(),
                                  truncate=False, normalize=False).collect()}
    assert got[1].embedding == [6.0, 1.0, float(ord("b")), 2.0]
    assert got[2].embedding == [10.0, 1.0, float(ord("x")), 2.0]
    assert (got[3].outcome.kind, got[3].outcome.message) == ("tokenize", "bad byte")
    rows = [("qwen", "document", ["a  b", "x" * 50], None), ("qwen", "document", ["\x00"], None)]
    out = {r.request_id: r for r in embed_requests(
        _requests(spark, rows), factory=CharacterFactory(), truncate=False, normalize=False).collect()}
    assert [v[0] for v in out[0].embeddings] == [6.0, 10.0]
    assert (out[1].status, out[1].detail) == (500, "qwen: tokenize failed: bad byte")


def test_other_columns_pass_through(spark):
    rows = spark.range(5).selectExpr(
        "id", "cast(id as string) as text", "timestamp'2024-01-02 03:04:05' + make_interval(0,0,0,cast(id as int)) as ts",
        "date'2024-01-02' as d", "timestamp_ntz'2024-01-02 03:04:05' as n", "cast(id as decimal(20,3)) as c",
        "map('k', id) as m", "array(id, null) as a", "named_struct('x', id, 'y', array('z')) as s",
        "cast(cast(id as string) as binary) as b", "if(id = 1, null, id > 2) as t", "cast(null as double) as f",
    )
    out = embed(rows, "text", "gemma", "query", 3)
    kept = [c for c in rows.columns if c != "text"]
    assert out.columns == [*kept, "embedding", "outcome"]
    key = lambda df: sorted(map(str, df.select(*kept).collect()))
    assert key(out) == key(rows)
