import pytest
from pyspark.sql import functions as F

from vectorloom.operators.provenance import canonical_builds
from vectorloom.registry import GEMMA, QWEN, models_table, parse_active


@pytest.mark.parametrize(
    "value,expected",
    [
        ("gemma,qwen", ["gemma", "qwen"]),
        (" qwen , ,gemma,qwen,", ["qwen", "gemma"]),
        (["qwen", " gemma "], ["qwen", "gemma"]),
        ("gemma", ["gemma"]),
    ],
)
def test_parse_active(value, expected):
    assert parse_active(value) == expected


@pytest.mark.parametrize("value", ["", " , ", [], "Gemma", "gemma,bert"])
def test_parse_active_refuses(value):
    with pytest.raises(ValueError):
        parse_active(value)


def test_models_table_keeps_order_and_resolves_builds(spark):
    table = models_table(spark, "qwen,gemma", overrides={"qwen": "mine.gguf", "gemma": ""})
    rows = table.orderBy("ord").collect()
    assert [r.model for r in rows] == ["qwen", "gemma"]
    assert [r.build for r in rows] == ["mine.gguf", GEMMA.default_build]
    assert [(r.native_dim, r.default_dim, r.token_limit, r.pooling) for r in rows] == [
        (4096, 768, 8191, "last"),
        (768, 768, 2047, "mean"),
    ]
    assert rows[0].query_prompt == QWEN.query_prompt and "\n" in rows[0].query_prompt
    assert rows[1].document_prompt.endswith(" ") and rows[0].document_prompt == ""


def test_canonical_builds(spark):
    rows = [("Q8_0", "x.gguf"), ("f16", None), ("F16", ""), ("q5_k_M", ""), ("", "x.gguf"), (None, ""), ("q9", "x.gguf")]
    df = spark.createDataFrame(rows, "q string, e string")
    got = [(r.build, r.build_error) for r in canonical_builds(df, F.col("q"), F.col("e")).collect()]
    build = "Qwen3-Embedding-8B-{}.gguf".format
    assert got == [
        (build("Q8_0"), None), (build("f16"), None), (build("f16"), None), (build("Q5_K_M"), None),
        ("x.gguf", None), (QWEN.default_build, None), (None, "unknown quantisation q9"),
    ]
