from vectorloom.operators.requests import validate_requests
from vectorloom.plans.bulk import embed_requests
from vectorloom.sources.requests import parse_requests, read_json_requests, read_requests
from pyspark.sql import functions as F

HEAD = '{"request_id": %d, "model": "gemma", "task": "query", '
CASES = [
    ('"payloads": ["a", ""]}', 200, 768, 2),
    ('"payloads": ["a"], "dimensions": 256}', 200, 256, 1),
    ('"payloads": ["a"], "dimensions": "256"}', 200, 256, 1),
    ('"payloads": ["a"], "dimensions": " 12 "}', 200, 12, 1),
    ('"payloads": ["a"], "dimensions": 256.0}', 200, 256, 1),
    ('"payloads": ["a"], "dimensions": 1e2}', 200, 100, 1),
    ('"payloads": ["a"], "dimensions": true}', 200, 1, 1),
    ('"payloads": ["a"], "dimensions": 100000000000000000000000}', 200, 768, 1),
    ('"payloads": []}', 200, 768, 0),
    ('"payloads": ["\\u00e9\\n\\"x\\""]}', 200, 768, 1),
    ('"payloads": ["a"], "dimensions": 256.5}', 422, None, None),
    ('"payloads": ["a"], "dimensions": "x"}', 422, None, None),
    ('"payloads": ["a"], "dimensions": "1e2"}', 422, None, None),
    ('"payloads": ["a"], "dimensions": null}', 422, None, None),
    ('"payloads": ["a"], "dimensions": [3]}', 422, None, None),
    ('"payloads": ["a"], "dimensions": false}', 422, None, None),
    ('"payloads": ["a"], "dimensions": 0}', 422, None, None),
    ('"payloads": ["a"], "dimensions": -1e30}', 422, None, None),
    ('"payloads": ["a", null]}', 422, None, None),
    ('"payloads": [null]}', 422, None, None),
    ('"payloads": ["a", 1]}', 422, None, None),
    ('"payloads": [1]}', 422, None, None),
    ('"payloads": "a"}', 422, None, None),
    ('"payloads": {"a": "b"}}', 422, None, None),
    ('"payloads": null}', 422, None, None),
    ('"dimensions": 3}', 422, None, None),
]


def test_widths_and_payload_lists(spark, tmp_path):
    path = str(tmp_path / "requests.json")
    with open(path, "w") as f:
        f.write("\n".join(HEAD % i + tail for i, (tail, *_) in enumerate(CASES)))
    checked = validate_requests(read_json_requests(spark, path), body_error=F.col("body_error"))
    got = {r.request_id: r for r in checked.collect()}
    assert len(got) == len(CASES)
    for i, (tail, status, dims, n) in enumerate(CASES):
        row = got[i]
        assert (row.error.status if row.error else 200) == status, tail
        if status == 200:
            assert (row.dimensions, len(row.payloads)) == (dims, n), tail


def test_broken_lines_do_not_stop_the_job(spark):
    good = HEAD % 1 + '"payloads": ["a"]}'
    lines = spark.createDataFrame(
        [(0, "nojson{"), (1, good), (2, "[1]"), (3, ""), (4, "3"), (5, '"x"'), (6, "{}")], "line int, value string"
    )
    out = embed_requests(parse_requests(lines), keys=("line",))
    assert {r.line: r.status for r in out.collect()} == {0: 422, 1: 200, 2: 422, 3: 422, 4: 422, 5: 422, 6: 404}


def test_model_from_the_job_for_lines_without_one(spark):
    """Files of one lane leave model and task to the job; then a broken body is a 422."""
    lines = spark.createDataFrame([(0, "nojson{"), (1, '{"payloads": ["a"]}'), (2, "[1]")], "line int, value string")
    parsed = parse_requests(lines, model="gemma", task="document", require_id=False)
    assert {r.line: r.status for r in embed_requests(parsed, keys=("line",)).collect()} == {0: 422, 1: 200, 2: 422}


def test_a_line_beyond_the_variant_limit_is_read_whole(spark):
    words = 20 * 1024 * 1024 // 8
    lines = spark.range(1).select(
        F.concat(
            F.lit('{"request_id":7,"model":"gemma","task":"query","dimensions":9,"payloads":["'),
            F.repeat(F.lit("wordone "), F.lit(words)), F.lit('"]}'),
        ).alias("value")
    )
    row = parse_requests(lines).select("request_id", "dimensions", "body_error", F.length(F.col("payloads")[0]).alias("n")).first()
    assert (row.request_id, row.dimensions, row.body_error, row.n) == (7, 9, None, words * 8)


def test_parquet_requests(spark, tmp_path):
    path = str(tmp_path / "requests")
    spark.createDataFrame([(1, "gemma", "query", ["a"], None)], "request_id long, model string, task string, payloads array<string>, dimensions long").write.parquet(path)
    assert [r.status for r in embed_requests(read_requests(spark, path)).collect()] == [200]


def test_an_id_has_to_be_a_whole_number(spark):
    bodies = ['{"request_id": %s"model": "gemma", "task": "query", "payloads": ["a"]}' % i for i in ('7, ', '"r-8", ', '1.5, ', 'null, ', '"9", ')]
    lines = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, value string")
    out = {r.k: r for r in embed_requests(parse_requests(lines), keys=("k", "request_id")).collect()}
    assert [(out[k].request_id, out[k].status) for k in range(5)] == [(7, 200), (None, 422), (None, 422), (None, 422), (9, 200)]
    assert out[1].detail == "request_id: input should be a valid integer" and out[1].request_line == bodies[1]
    assert out[0].request_line is None


def test_long_lines_are_as_strict_as_short_ones(spark):
    """Every kind of width and payload list, with a short and with a 22 MB payload."""
    kinds = ["256.5", '"abc"', "null", "true", "0", "256", None]
    rows = [(k, f"{d}" if d else None, "", "") for k, d in enumerate(kinds)]
    rows += [(len(rows), "256", "1, ", ""), (len(rows) + 1, "256", "", "cut")]
    frame = spark.createDataFrame(rows, "k int, width string, before string, cut string").crossJoin(
        spark.createDataFrame([(1,), (22_000_000,)], "n int")
    )
    width = F.coalesce(F.concat(F.lit(', "dimensions": '), "width"), F.lit(""))
    line = F.concat(
        F.lit('{"request_id": 1, "model": "gemma", "task": "query", "payloads": ['), "before", F.lit('"'),
        F.expr("repeat('x', n)"), F.lit('"]'), width, F.when(F.col("cut") == "", "}").otherwise(""),
    )
    parsed = parse_requests(frame.select("k", "n", line.alias("value")))
    checked = validate_requests(parsed, body_error=F.col("body_error")).select(
        "k", "n", "error.status", "error.detail", "dimensions", F.length(F.col("payloads")[0]).alias("length")
    )
    found = {(r.k, r.n): r for r in checked.collect()}
    for k, *_ in rows:
        short, long = found[k, 1], found[k, 22_000_000]
        assert (short.status, short.detail, short.dimensions) == (long.status, long.detail, long.dimensions), k
        assert (short.length, long.length) in ((1, 22_000_000), (None, None))
    assert [found[k, 22_000_000].status for k, *_ in rows] == [422, 422, 422, None, 422, None, None, 422, 422]
