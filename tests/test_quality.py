from vectorloom.operators.quality import (
    all_vectors_pass,
    count_checks,
    long_count_checks,
    status_rollup,
    vector_checks,
)
from vectorloom.operators.provenance import space_guard


def test_vector_checks(spark):
    nan = float("nan")
    rows = [(0, [0.6, 0.8]), (1, [0.6, 0.8, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [0.6005, 0.8])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    checked = vector_checks(df, "v", 2)
    got = [(r.dim_ok, r.norm_ok, r.is_zero) for r in checked.orderBy("i").collect()]
    t, f = True, False
    assert got == [(t, t, f), (f, t, f), (t, f, f), (t, f, t), (t, f, f), (t, t, f)]
    assert tuple(all_vectors_pass(checked).first()) == (6, 4, False)
    assert tuple(all_vectors_pass(checked.where("i = 0")).first()) == (1, 0, True)
    assert tuple(all_vectors_pass(checked.where("i > 99")).first()) == (0, 0, True)


def test_counts(spark):
    rows = [(1, ["a", "b"], [[1.0], [1.0]]), (2, ["a"], []), (3, [], [])]
    df = spark.createDataFrame(rows, "request_id long, payloads array<string>, embeddings array<array<float>>")
    assert [r.count_ok for r in count_checks(df).collect()] == [True, False, True]
    payloads = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, -1)], "request_id long, payload_index int")
    vectors = spark.createDataFrame([(1, [1.0]), (1, [2.0])], "request_id long, embedding array<float>")
    got = {r.request_id: (r.n_payloads, r.n_vectors, r.count_ok) for r in long_count_checks(payloads, vectors).collect()}
    assert got == {1: (2, 2, True), 2: (1, 0, False), 3: (0, 0, True)}


def test_status_rollup(spark):
    schema = "model string, status int, kind string"

    def roll(rows, **options):
        frame = spark.createDataFrame(rows, schema)
        return {r.model: (r.n_ok, r.n_failed, r.status, r.healthy) for r in status_rollup(frame, **options).collect()}

    fine = [("gemma", 200, None), ("gemma", 422, None), ("qwen", 200, None), ("bogus", 404, None)]
    gone, loading = ("qwen", 503, "unavailable"), ("qwen", 503, "rejected")
    assert roll(fine) == {"gemma": (1, 0, "ok", True), "qwen": (1, 0, "ok", True)}
    assert roll(fine + [gone, ("qwen", 500, "exception")]) == {
        "gemma": (1, 0, "ok", False), "qwen": (1, 2, "unreachable", False)
    }
    assert roll(fine + [loading])["qwen"] == (1, 1, "loading", False)
    assert roll(fine + [gone], active="gemma") == {"gemma": (1, 0, "ok", True)}
    assert roll([("gemma", 200, None)])["qwen"] == (0, 0, "ok", True)
    # A bad text says nothing about readiness.
    assert roll([("qwen", 200, None)] * 99 + [("qwen", 500, "rejected")])["qwen"] == (99, 1, "ok", True)


def test_space_guard(spark):
    rows = [("a", "gemma", "x")] * 50 + [("b", "gemma", "x"), ("b", "gemma", "y"), ("c", "qwen", "x"), ("c", "gemma", "x")]
    df = spark.createDataFrame(rows, "index_id string, model string, build string")
    got = {r.index_id: (r.n_spaces, r.mixed) for r in space_guard(df).collect()}
    assert got == {"a": (1, False), "b": (2, True), "c": (2, True)}
