"""Totals from the pass that writes, tables of one space, and lines that are too long."""

import json

import pytest
from pyspark.sql import Observation, functions as F

from vectorloom.operators.quality import all_vectors_pass, count_checks, observe_counts, observe_vectors, vector_checks
from vectorloom.operators.tokens import observe_truncation, token_usage, truncation_report
from vectorloom.sources import requests as reading
from vectorloom.sources.requests import parse_requests
from vectorloom.sources.sinks import claim_space, write_vectors


def test_totals_are_those_of_the_reports(spark, small, tmp_path):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    vectors = vectors.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 9)).otherwise(F.col("embedding")))
    checked, totals = vector_checks(vectors, "embedding", 64), Observation()
    observe_vectors(checked, totals).write.parquet(str(tmp_path / "v"))
    assert totals.get == all_vectors_pass(checked).first().asDict() and totals.get["n_bad"] > 0

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.selectExpr("doc_id", "'gemma' as model", "'document' as task", "text as payload")
    usage, totals = token_usage(rows), Observation()
    observe_truncation(usage, totals).write.parquet(str(tmp_path / "t"))
    assert totals.get == truncation_report(usage).first().asDict() and totals.get["n_truncated"] > 0

    answers = docs.selectExpr("array(text, text) as payloads", "if(doc_id % 5 = 0, array(1), array(1, 2)) as embeddings")
    totals = Observation()
    observe_counts(answers, totals).write.parquet(str(tmp_path / "c"))
    bad = count_checks(answers).where("not count_ok").count()
    assert totals.get == {"n_requests": 200, "n_bad": bad, "n_vectors": 400 - bad} and bad


def test_a_table_of_one_space_refuses_another(spark, tmp_path):
    path = str(tmp_path / "index")
    frame = spark.sql("SELECT 1 AS id, array(1.0, 0.0) AS embedding, 'gemma' AS model, 'a.gguf' AS build, 'query' AS task, 2 AS dimensions")
    write_vectors(frame, path, space=("gemma", "a.gguf"))
    write_vectors(frame, path, space=("gemma", "a.gguf"))  # tried again
    with pytest.raises(ValueError, match="holds vectors of"):
        write_vectors(frame, path, space=("gemma", "b.gguf"))
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="another space"):
        write_vectors(frame.withColumn("build", F.lit("b.gguf")), path, space=("gemma", "a.gguf"))
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "dead.space").write_text("")
    with pytest.raises(ValueError, match="its writer died"):
        claim_space(spark, str(tmp_path / "dead"), "gemma", "a.gguf")


def test_a_line_beyond_the_limit_has_its_own_reason(spark, monkeypatch):
    monkeypatch.setattr(reading, "VARIANT_BYTES", 64)  # a broken line stands for one that Spark refuses
    lines = [json.dumps({"request_id": 1, "payloads": ["x" * 90]}), '{"request_id": 2, ' + "x" * 90, "{"]
    rows = parse_requests(spark.createDataFrame([(x,) for x in lines], "value string"), model="gemma", task="query").collect()
    told = {r.request_line[:18] if r.request_line else "": r.body_error.detail if r.body_error else None for r in rows}
    assert told[""] is None and told["{"] == "body: JSON decode error"
    assert told['{"request_id": 2, '] == "body: a line of more than 0 MiB cannot be read as one value"
