"""Checks on vectors, responses and job outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from vectorloom.functions.vectors import l2_norm
from vectorloom.registry import REGISTRY, ModelFacts, models_table, parse_active

# Fixed value: how far from 1 a length may be.
NORM_TOLERANCE = 1e-3


def vector_checks(vectors: DataFrame, vector: str, expected_dim: Column | int) -> DataFrame:
    """Each row with ``norm``, ``dim_ok``, ``norm_ok`` and ``is_zero``.

    A zero vector is what normalising a zero or NaN vector gives; it fails ``norm_ok`` and
    ``is_zero`` says why.
    """
    expected = F.lit(expected_dim) if isinstance(expected_dim, int) else expected_dim
    checked = vectors.withColumn("norm", l2_norm(F.col(vector)))
    norm = F.col("norm")
    return checked.select(
        "*",
        (F.size(vector) == expected).alias("dim_ok"),
        ((F.abs(norm - 1) < NORM_TOLERANCE) & ~F.isnan(norm)).alias("norm_ok"),
        (norm == 0).alias("is_zero"),
    )


def all_vectors_pass(checked: DataFrame) -> DataFrame:
    """One row: how many vectors there are, how many fail, and whether none does."""
    return checked.agg(*_vector_totals())


def observe_vectors(checked: DataFrame, totals: Observation) -> DataFrame:
    """``checked`` as it is; what :func:`all_vectors_pass` tells is in ``totals`` once it was
    written, from the same pass."""
    return checked.observe(totals, *_vector_totals())


def _vector_totals() -> list[Column]:
    good = F.col("dim_ok") & F.col("norm_ok")
    return [
        F.count(F.lit(1)).alias("n_vectors"),
        F.count_if(~good).alias("n_bad"),
        F.coalesce(F.bool_and(good), F.lit(True)).alias("passed"),
    ]


def count_checks(responses: DataFrame) -> DataFrame:
    """Array-form responses with ``count_ok``: one vector per payload."""
    return responses.withColumn("count_ok", F.size("embeddings") == F.size("payloads"))


def observe_counts(responses: DataFrame, totals: Observation) -> DataFrame:
    """:func:`count_checks`, with the number of requests, of those that fail and of vectors in
    ``totals`` once the result was written."""
    return count_checks(responses).observe(
        totals,
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if(~F.col("count_ok")).alias("n_bad"),
        F.coalesce(F.sum(F.size("embeddings")), F.lit(0)).alias("n_vectors"),
    )


def long_count_checks(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """The same in long form: ``n_payloads``, ``n_vectors``, ``count_ok`` per request. The
    row that stands for an empty request counts as no payload."""
    expected = rows.groupBy("request_id").agg(F.count_if(F.col("payload_index") >= 0).alias("n_payloads"))
    found = vectors.groupBy("request_id").agg(F.count("embedding").alias("n_vectors"))
    return (
        expected.join(found, "request_id", "left")
        .withColumn("n_vectors", F.coalesce("n_vectors", F.lit(0).cast("long")))
        .withColumn("count_ok", F.col("n_vectors") == F.col("n_payloads"))
    )


def status_rollup(
    outcomes: DataFrame,
    active: str | Sequence[str] | None = None,
    registry: Sequence[ModelFacts] = REGISTRY,
    overrides: dict[str, str] | None = None,
    backend: str = "cpu",
) -> DataFrame:
    """Readiness per active model from the ``model, status, kind`` of finished requests.

    Only what the model did counts: a request refused with 404 or 422 never reached it.
    ``unreachable`` means a call found no model (by the ``kind`` of the outcome, never by the
    wording of a message), ``loading`` that the model answered 503, ``ok`` neither: a text
    that fails with 500 says nothing about readiness. ``healthy`` is true everywhere if every active model is ``ok``.
    """
    models = models_table(outcomes.sparkSession, active, overrides, registry)
    # Restricted to active models first, so the counts have at most MAX_MODELS rows
    # however many unknown names the requests bring.
    counts = (
        outcomes.join(F.broadcast(models.select("model")), "model", "left_semi")
        .groupBy("model")
        .agg(*[F.count_if(counted).alias(name) for name, counted in _answers().items()])
    )
    zero = F.lit(0).cast("long")
    per_model = models.join(F.broadcast(counts), "model", "left").select(
        "ord", "model", "name", F.col("build").alias("file"),
        F.col("native_dim").alias("dimension"), F.col("default_dim").alias("default_dimension"),
        F.lit("cpu" if backend == "cpu" else "gpu").alias("device"), F.lit(backend).alias("backend"),
        F.coalesce("n_ok", zero).alias("n_ok"),
        F.coalesce("n_failed", zero).alias("n_failed"),
        F.when(F.col("n_unreachable") > 0, "unreachable")
        .when(F.col("n_loading") > 0, "loading")
        .otherwise("ok")
        .alias("status"),
    )
    facts = F.struct(*per_model.columns)
    return per_model.agg(
        F.bool_and(F.col("status") == "ok").alias("healthy"), F.collect_list(facts).alias("models")
    ).select("healthy", F.inline("models"))


def _answers() -> dict[str, Column]:
    """What readiness counts among the outcomes of a model."""
    gone = F.col("kind") == "unavailable"
    return {
        "n_ok": F.col("status") == 200,
        "n_failed": F.col("status") >= 500,
        "n_unreachable": gone,
        "n_loading": (F.col("status") == 503) & ~F.coalesce(gone, F.lit(False)),
    }


def status_totals(
    active: str | Sequence[str] | None = None, registry: Sequence[ModelFacts] = REGISTRY
) -> list[Column]:
    """The counts behind :func:`status_rollup` as aggregates to observe, four per active model.

    For a pass over ``model, status, kind`` that is made anyway, of a batch or a stream;
    :func:`readiness` reads the result.
    """
    names = [m.key for m in registry] if active is None else parse_active(active, registry)
    return [
        F.count_if((F.col("model") == model) & counted).alias(f"{name}_{place}")
        for place, model in enumerate(names)
        for name, counted in _answers().items()
    ]


def readiness(
    totals: Mapping[str, int], active: str | Sequence[str] | None = None, registry: Sequence[ModelFacts] = REGISTRY
) -> list[dict]:
    """``model, n_ok, n_failed, status`` of every active model from observed ``status_totals``,
    by the rule of :func:`status_rollup`. A few numbers on the driver; no job runs."""
    names = [m.key for m in registry] if active is None else parse_active(active, registry)
    found = []
    for place, model in enumerate(names):
        n = {name: totals[f"{name}_{place}"] for name in _answers()}
        status = "unreachable" if n["n_unreachable"] else "loading" if n["n_loading"] else "ok"
        found.append({"model": model, "n_ok": n["n_ok"], "n_failed": n["n_failed"], "status": status})
    return found
