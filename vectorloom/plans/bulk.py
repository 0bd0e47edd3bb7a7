"""Bulk embedding jobs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from vectorloom.encoders import EncoderFactory, HashingFactory
from vectorloom.functions.failures import classify_failure
from vectorloom.functions.prompts import apply_prompt
from vectorloom.functions.tokens import fit_text
from vectorloom.operators.embedding import ROW_BYTES, encode_requests, encode_texts
from vectorloom.operators.requests import (
    EMPTY_LIST,
    first_failures,
    fits_row,
    regroup_responses,
    request_rows,
    validate_requests,
)
from vectorloom.registry import DEFAULT_DIMENSIONS, REGISTRY, TASKS, ModelFacts
from vectorloom.schemas import ERROR, OUTCOME
from vectorloom.session import attach, materialize


# The kind of an outcome whose vectors exceed one row.
LARGE = "large"


def stand_in(registry: Sequence[ModelFacts] = REGISTRY) -> HashingFactory:
    """The hashing encoder at the native width of every model."""
    return HashingFactory(tuple((m.key, m.native_dim) for m in registry))


def model_text(text: Column, facts: ModelFacts, task: str, truncate: bool = True) -> Column:
    """What the encoder of a model sees of a text: prompt in front, cut to the context."""
    prompted = apply_prompt(
        text, F.lit(task), F.lit(facts.query_prompt), F.lit(facts.document_prompt)
    )
    if not truncate:
        return prompted
    return fit_text(prompted, F.lit(facts.n_ctx - 1), F.lit(facts.start_tokens + facts.end_tokens))


def embed(
    texts: DataFrame,
    text_col: str,
    model: str,
    task: str,
    dimensions: int = DEFAULT_DIMENSIONS,
    *,
    keys: Iterable[str] | None = None,
    factory: EncoderFactory | None = None,
    registry: Sequence[ModelFacts] = REGISTRY,
    truncate: bool = True,
    **options,
) -> DataFrame:
    """Embed one text per row with one model and task, all known when the job is planned.

    Model facts become literals, so the plan is scan, project, Arrow stage: no join and no
    shuffle. Works on batch and streaming frames. ``keys`` (default: every other column)
    are carried through; the result adds ``embedding`` and ``outcome``.

    A null text has the outcome ``missing``, without a call.

    Texts are cut to the model's context by words, the stand-in for tokens. Pass
    ``truncate=False`` to an encoder that cuts by its own tokens, such as a ``TokenEncoder``.
    """
    facts = {m.key: m for m in registry}.get(model)
    if facts is None:
        raise ValueError(f"unknown model {model!r}")
    if task not in TASKS:
        raise ValueError(f"task must be one of {TASKS}")
    if dimensions < 1:
        raise ValueError("dimensions must be at least 1")
    attach(texts.sparkSession)
    keys = [c for c in texts.columns if c != text_col] if keys is None else list(keys)
    prepared = texts.select(
        *keys,
        F.lit(model).alias("model"),
        F.lit(task).alias("task"),
        model_text(F.col(text_col), facts, task, truncate).alias("text"),
        F.lit(dimensions).alias("dimensions"),
    )
    encoded = encode_texts(prepared, factory or stand_in(registry), keys, **options)
    none = F.struct(F.lit("missing"), F.lit(None).cast("int"), F.lit("the text is null")).cast(OUTCOME)
    return encoded.withColumn("outcome", F.coalesce("outcome", none))


def embed_requests(
    requests: DataFrame,
    *,
    keys: Sequence[str] = ("request_id",),
    active: str | Iterable[str] | None = None,
    overrides: dict[str, str] | None = None,
    factory: EncoderFactory | None = None,
    registry: Sequence[ModelFacts] = REGISTRY,
    truncate: bool = True,
    row_bytes: int = ROW_BYTES,
    **options,
) -> DataFrame:
    """Array-form requests to one outcome row each, in one pass without a shuffle.

    The result holds the keys and ``model, task, build, dimensions, embeddings, status,
    detail, kind``, and the ``request_line`` of requests that could not be read, if they have one. Status is 200, or what validation or the encoder reported; failed requests
    have no embeddings and do not affect others. A request without payloads succeeds with
    no vectors and no call. Refused requests pass the encoder stage with null texts, so
    the input is scanned once. So do requests whose vectors exceed ``row_bytes``: their kind is
    ``large``, and :func:`embed_large_requests` answers them.
    """
    attach(requests.sparkSession)
    if "request_line" in requests.columns and "request_line" not in keys:
        keys = [*keys, "request_line"]
    body_error = F.col("body_error") if "body_error" in requests.columns else None
    valid = validate_requests(requests, active, registry, overrides, body_error)
    prompted = F.transform("payloads", lambda p: _routed_text(p, truncate))
    kept = [*keys, "model", "task", "build", "dimensions"]
    valid = valid.withColumn("error", F.coalesce("error", F.when(~fits_row(row_bytes, registry), _too_large())))
    callable_ = F.col("error").isNull() & (F.size("payloads") > 0)
    prepared = valid.select(*kept, "error", F.when(callable_, prompted).alias("texts"))
    encoded = encode_requests(
        prepared, factory or stand_in(registry), [*kept, "error"], **options
    )
    error = F.coalesce("error", classify_failure(F.col("outcome"), F.col("model")))
    empty = F.array().cast(encoded.schema["embeddings"].dataType)
    return encoded.withColumn("error", error).select(
        *kept,
        F.when(F.col("error").isNull(), F.coalesce("embeddings", empty)).alias("embeddings"),
        F.coalesce("error.status", F.lit(200)).alias("status"),
        F.col("error.detail").alias("detail"),
        F.col("error.kind").alias("kind"),
    )


def _too_large() -> Column:
    detail = "the vectors of this request exceed one row; pass it in long form"
    return F.struct(F.lit(500).alias("status"), F.lit(detail).alias("detail"), F.lit(LARGE).alias("kind")).cast(ERROR)


def embed_large_requests(
    requests: DataFrame, *, keys: Sequence[str] = ("request_id",), part_texts: int = 1024, **options
) -> tuple[DataFrame, DataFrame]:
    """Array-form requests whose answers exceed one row, to ``(outcomes, parts)``.

    ``outcomes`` are those of :func:`embed_requests` without vectors: ``embeddings`` is null
    for every one. ``parts`` holds the keys, ``part`` and ``embeddings`` of the good ones, at most
    ``part_texts`` vectors a row; the parts of a request, in order, are its answer. Requests are
    told apart by a number of their own, so null and repeated keys are fine. For the few large
    requests of a job: they are stored, encoded once in long form, and what moves behind
    the encoder are slices of ``part_texts`` vectors.
    """
    if "request_line" in requests.columns and "request_line" not in keys:
        keys = [*keys, "request_line"]
    checks = {k: options[k] for k in ("active", "registry", "overrides") if options.get(k) is not None}
    body_error = F.col("body_error") if "body_error" in requests.columns else None
    numbered = materialize(requests.withColumn("_request", F.monotonically_increasing_id()), "large")
    rows = request_rows(numbered.select(F.col("_request").alias("request_id"), "model", "task", "dimensions", "payloads"))
    failures, vectors = embed_request_texts(rows, **options)
    failed = failures.select(F.col("request_id").alias("_request"), F.struct("status", "detail", "kind").cast(ERROR).alias("_failure"))
    kept = ["model", "task", "build", "dimensions"]
    none = F.lit(None).cast(T.ArrayType(vectors.schema["embedding"].dataType))
    outcomes = (
        validate_requests(numbered, body_error=body_error, **checks)
        .select("_request", *keys, *kept, "error")
        .join(failed, "_request", "left")
        .withColumn("_failure", F.coalesce("error", "_failure"))
        .select(
            *keys, *kept, none.alias("embeddings"), F.coalesce("_failure.status", F.lit(200)).alias("status"),
            F.col("_failure.detail").alias("detail"), F.col("_failure.kind").alias("kind"),
        )
    )
    answered = regroup_responses(vectors, part_texts).withColumnRenamed("request_id", "_request")
    parts = numbered.select("_request", *keys).join(answered, "_request").select(*keys, "part", "embeddings")
    return outcomes, parts


def encode_request_texts(
    rows: DataFrame,
    *,
    active: str | Iterable[str] | None = None,
    overrides: dict[str, str] | None = None,
    factory: EncoderFactory | None = None,
    registry: Sequence[ModelFacts] = REGISTRY,
    truncate: bool = True,
    **options,
) -> DataFrame:
    """Long-form requests to one row per payload with its ``embedding`` or its ``error``.

    The row that stands for a request without payloads (see ``request_rows``) stays a row: with
    neither for an empty list, with an error for a missing one.

    ``error_rank`` is null or says which errors of a request come first: 0 a payload that
    is not a string, 1 anything else found before encoding, 2 a failed call.

    No shuffle. What a payload's error means for the rest of its request is settled
    afterwards by :func:`embed_request_texts`. Usable on streams.
    """
    attach(rows.sparkSession)
    index = F.col("payload_index")
    listed = F.when(index >= 0, F.array("payload")).when(index == EMPTY_LIST, F.array().cast("array<string>"))
    single = rows.withColumn("payloads", listed)
    keys = ["request_id", "payload_index", "model", "task", "build", "dimensions", "error"]
    own = F.col("payload").isNull() & (index >= 0) & (F.col("error.status") == 422)
    rank = F.when(own, 0).when(F.col("error").isNotNull(), 1)
    prepared = validate_requests(single, active, registry, overrides).select(
        *keys,
        rank.alias("error_rank"),
        F.when(F.col("error").isNull() & (index >= 0), _routed_text(F.col("payload"), truncate)).alias("text"),
    )
    encoded = encode_texts(
        prepared, factory or stand_in(registry), [*keys, "error_rank"], **options
    )
    failure = classify_failure(F.col("outcome"), F.col("model"))
    return encoded.select(
        *keys[:-1],
        "embedding",
        F.coalesce("error", failure).alias("error"),
        F.coalesce("error_rank", F.when(failure.isNotNull(), 2)).alias("error_rank"),
    )


def embed_request_texts(rows: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Long-form requests of any size to ``(failures, vectors)``.

    The encoder runs once: its output is stored below ``spark.checkpoint.dir`` and both
    results are read from there.
    """
    return first_failures(materialize(encode_request_texts(rows, **options), "encoded"))


def _routed_text(payload: Column, truncate: bool) -> Column:
    """What the encoder sees of a payload of a routed request."""
    prompted = apply_prompt(payload, F.col("task"), F.col("query_prompt"), F.col("document_prompt"))
    if not truncate:
        return prompted
    return fit_text(prompted, F.col("token_limit"), F.col("n_special"))
