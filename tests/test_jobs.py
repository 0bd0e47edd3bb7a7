import json

import pytest

from vectorloom.__main__ import main


def _lines(path, rows):
    path.mkdir()
    (path / "0.json").write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_request_job(spark, tmp_path):
    source = _lines(tmp_path / "in", [{"request_id": i, "payloads": [p], "dimensions": 2} for i, p in enumerate(["1", "gone", 3])])
    out = str(tmp_path / "out")
    main(["requests", "--input", source, "--output", out, "--model", "gemma", "--task", "query", "--encoder", "fakes:numbers"], spark)
    good = spark.read.json(f"{out}/responses").collect()
    assert [r.request_id for r in good] == [0] and len(good[0].embeddings[0]) == 2
    bad = {r.request_id: r.status for r in spark.read.parquet(f"{out}/errors").collect()}
    assert bad == {1: 503, 2: 422}


def test_request_stream_job(spark, tmp_path):
    rows = [{"request_id": i, "model": m, "task": "query", "payloads": ["a"]} for i, m in enumerate(["gemma", "qwen"])]
    out = str(tmp_path / "out")
    args = ["requests", "--input", _lines(tmp_path / "in", rows), "--output", out, "--checkpoint", str(tmp_path / "cp")]
    main([*args, "--models", "gemma", "--build", "gemma=mine.gguf"], spark)
    got = {r.request_id: (r.status, r.build) for r in spark.read.parquet(f"{out}/outcomes").collect()}
    assert got == {0: (200, "mine.gguf"), 1: (404, None)}


def test_text_job(spark, tmp_path):
    source, out, errors = (str(tmp_path / n) for n in ("in", "out", "errors"))
    spark.createDataFrame([(1, "a"), (2, "b")], "key long, body string").write.parquet(source)
    args = ["texts", "--input", source, "--id", "key", "--text", "body", "--output", out, "--errors", errors, "--model", "qwen"]
    main([*args, "--dimensions", "16", "--qwen-quant", "q8_0"], spark)
    rows = spark.read.parquet(out).collect()
    assert {(r.id, r.build, r.dimensions, len(r.embedding)) for r in rows} == {
        (i, "Qwen3-Embedding-8B-Q8_0.gguf", 16, 16) for i in (1, 2)
    }
    assert spark.read.parquet(errors).count() == 0
    with pytest.raises(SystemExit):
        main([*args, "--qwen-quant", "q9"], spark)
    with pytest.raises(SystemExit):
        main([*args, "--models", "gemma"], spark)
    with pytest.raises(ValueError):
        main([*args, "--models", "bert"], spark)
