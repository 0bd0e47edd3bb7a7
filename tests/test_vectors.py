import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from vectorloom.functions import dot, finalize, l2_norm, l2_normalize, truncate_dims
from vectorloom.operators.embedding import _unit
from vectorloom.operators.pooling import pool_last, pool_mean

NAN, INF = float("nan"), float("inf")
EDGE = [
    ([3.0, 4.0], 2, [0.6, 0.8]),
    ([0.0, 0.0], 2, [0.0, 0.0]),
    ([NAN, 1.0], 2, [0.0, 0.0]),
    ([3.0, 4.0, 12.0], 2, [0.6, 0.8]),
    ([1.0, 1.0, 1.0, 1.0], 9, [0.5] * 4),
    ([1.0, 1.0, 1.0, 1.0], 10**12, [0.5] * 4),
    ([INF, 1.0, 2.0], 3, [NAN, 0.0, 0.0]),
    ([3e-30, 4e-30], 2, [0.6, 0.8]),
]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_finalize_edge_rows(spark, kind):
    df = spark.createDataFrame([(i, v, d) for i, (v, d, _) in enumerate(EDGE)], f"i int, v array<{kind}>, d long")
    for row in df.select("i", finalize(F.col("v"), F.col("d")).alias("out")).collect():
        expected = EDGE[row.i][2]
        assert len(row.out) == len(expected)
        for got, want in zip(row.out, expected):
            assert (math.isnan(got) and math.isnan(want)) or abs(got - want) < 1e-6


def test_encoder_side_scaling_agrees_with_the_expression(spark):
    rng = np.random.default_rng(1)
    block = rng.normal(size=(50, 16)).astype(np.float32)
    block[3], block[4, 2] = 0, np.nan
    block[5, 1] = np.inf
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(block)], "i int, v array<float>")
    got = np.array([r.u for r in df.select("i", l2_normalize(F.col("v")).alias("u")).orderBy("i").collect()])
    np.testing.assert_allclose(got, _unit(block), atol=1e-12, equal_nan=True)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(st.floats(width=32), max_size=6), st.integers(1, 8)), min_size=20, max_size=40))
def test_finalize_gives_length_one_or_zeros(spark, rows):
    df = spark.createDataFrame([(i, v, d) for i, (v, d) in enumerate(rows)], "i int, v array<float>, d int")
    for row in df.select("i", finalize(F.col("v"), F.col("d")).alias("out")).collect():
        v, d = rows[row.i]
        cut = np.array(v[:d], np.float64)
        assert len(row.out) == len(cut)
        norm = np.sqrt((cut * cut).sum())
        if np.isfinite(norm) and norm > 0:
            np.testing.assert_allclose(row.out, cut / norm, atol=1e-12)
            assert abs(np.linalg.norm(row.out) - 1) < 1e-9
        elif not np.isinf(norm):
            assert not any(row.out)


def test_finalize_is_idempotent_and_unit(spark, small):
    v = spark.read.parquet(f"{small}/embeddings.parquet").select(finalize(F.col("embedding"), F.lit(24)).alias("v"))
    again = v.select("v", finalize(F.col("v"), F.lit(24)).alias("w"))
    worst = again.select(
        F.max(F.abs(l2_norm(F.col("v")) - 1)), F.max(F.abs(dot(F.col("v"), F.col("w")) - 1))
    ).first()
    assert max(worst) < 1e-9


def test_truncate_dims(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<float>")
    got = df.select(*[truncate_dims(F.col("v"), F.lit(d)) for d in (1, 3, 7)]).first()
    assert [list(x) for x in got] == [[1.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]]


def test_pooling_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    # One key holds most of the rows.
    rows = [(0 if rng.random() < 0.7 else int(rng.integers(1, 9)), i, rng.normal(size=5).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, token_index int, vector array<float>").repartition(7)
    mean = {r.id: r.pooled for r in pool_mean(df, "id").collect()}
    last = {r.id: r.pooled for r in pool_last(df, "id").collect()}
    for key in {r[0] for r in rows}:
        mine = np.array([np.float32(v) for k, _, v in rows if k == key], np.float64)
        np.testing.assert_allclose(mean[key], mine.mean(axis=0), atol=1e-9)
        np.testing.assert_allclose(last[key], mine[-1], atol=1e-9)
