"""Request-grain operators: route, validate, explode, isolate, regroup.

Requests come in two forms. In array form a request is one row with its payloads, as a
client sends it. In long form every payload is a row ``(request_id, payload_index)``, for
requests of any size; nothing here gathers such a request into one row or one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vectorloom.functions.binding import int_div
from vectorloom.functions.validation import (
    check_dimensions,
    check_payloads,
    effective_dimensions,
    request_error,
)
from vectorloom.registry import REGISTRY, ModelFacts, models_table, parse_active
from vectorloom.session import materialize

# Payload rows of one request that share a join or aggregation key.
SLICE_ROWS = 4096
# Payload index of the one row that stands for a request without payloads.
EMPTY_LIST, NO_LIST = -1, -2
# Failed requests that are broadcast: two integers each, about 16 MB in all.
FEW_REQUESTS = 1_000_000


def route(
    requests: DataFrame,
    active: str | Sequence[str] | None = None,
    registry: Sequence[ModelFacts] = REGISTRY,
    overrides: dict[str, str] | None = None,
) -> DataFrame:
    """Attach the facts of each request's model; they stay null for a model not active.

    The registry side is a literal relation of at most ``MAX_MODELS`` rows, so it is
    broadcast and the requests are not shuffled.
    """
    models = models_table(requests.sparkSession, active, overrides, registry)
    facts = models.select(
        "model", "build", "native_dim", "query_prompt", "document_prompt", "token_limit",
        (F.col("start_tokens") + F.col("end_tokens")).alias("n_special"),
    )
    return requests.join(F.broadcast(facts), "model", "left")


def only_active(
    requests: DataFrame, active: str | Sequence[str], registry: Sequence[ModelFacts] = REGISTRY
) -> DataFrame:
    """The requests for active models."""
    models = models_table(requests.sparkSession, active, registry=registry)
    return requests.join(F.broadcast(models.select("model")), "model", "left_semi")


def validate_requests(
    requests: DataFrame,
    active: str | Sequence[str] | None = None,
    registry: Sequence[ModelFacts] = REGISTRY,
    overrides: dict[str, str] | None = None,
    body_error: Column | None = None,
) -> DataFrame:
    """Routed array-form requests with ``error`` (null if fine) and the width they get:
    what was asked for or the default, at most the model's own.

    ``body_error`` is an error found while parsing, reported before the checks made here.
    """
    names = [m.key for m in registry] if active is None else parse_active(active, registry)
    checks = [check_payloads(F.col("payloads")), check_dimensions(F.col("dimensions"))]
    if body_error is not None:
        checks.insert(0, body_error)
    error = request_error(
        F.col("model"), F.col("task"), F.col("native_dim").isNotNull(), names, *checks
    )
    return (
        route(requests, active, registry, overrides)
        .withColumn("error", error)
        .withColumn(
            "dimensions", F.least(effective_dimensions(F.col("dimensions")), F.col("native_dim"))
        )
    )


def validate_request_texts(
    rows: DataFrame,
    active: str | Sequence[str] | None = None,
    registry: Sequence[ModelFacts] = REGISTRY,
) -> DataFrame:
    """One row per long-form request with its ``n_payloads`` and ``error``.

    Payload rows are counted with partial aggregates over narrow columns; a request's
    texts never meet in one task.
    """
    names = [m.key for m in registry] if active is None else parse_active(active, registry)
    real = F.col("payload_index") >= 0
    heads = rows.groupBy("request_id", "model", "task", "dimensions").agg(
        F.count_if(real).alias("n_payloads"),
        F.count_if(real & F.col("payload").isNull()).alias("n_null"),
        F.count_if(F.col("payload_index") == NO_LIST).alias("n_missing"),
    )
    # Stands in for the payload list: only whether it is there and holds a null matters.
    stub = F.when(F.col("n_missing") == 0, F.array(F.when(F.col("n_null") == 0, F.lit(""))))
    error = request_error(
        F.col("model"),
        F.col("task"),
        F.col("native_dim").isNotNull(),
        names,
        check_payloads(stub),
        check_dimensions(F.col("dimensions")),
    )
    return (
        route(heads, active, registry)
        .withColumn("error", error)
        .select("request_id", "model", "task", "dimensions", "n_payloads", "error")
    )


def request_rows(requests: DataFrame) -> DataFrame:
    """Long form of array-form requests: one row per payload, numbered from 0.

    A request with an empty list, or with none at all, is one row without a payload and with
    the index ``EMPTY_LIST`` or ``NO_LIST``, so that it is answered as well.
    """
    none = F.when(F.col("payloads").isNull(), NO_LIST).otherwise(EMPTY_LIST)
    kept = [c for c in requests.columns if c != "payloads"]
    return requests.select(
        *kept, none.alias("_none"), F.posexplode_outer("payloads").alias("payload_index", "payload")
    ).select(*kept, F.coalesce("payload_index", "_none").alias("payload_index"), "payload")


def split_by_size(
    requests: DataFrame, row_bytes: int, registry: Sequence[ModelFacts] = REGISTRY
) -> tuple[DataFrame, DataFrame]:
    """Requests whose vectors fit into one row of ``row_bytes``, and the rest in long form."""
    fits = fits_row(row_bytes, registry)
    return requests.where(fits), request_rows(requests.where(~fits))


def fits_row(row_bytes: int, registry: Sequence[ModelFacts] = REGISTRY) -> Column:
    """Whether the vectors of an array-form request fit into one row of ``row_bytes``."""
    native = F.coalesce(*[F.when(F.col("model") == m.key, m.native_dim) for m in registry], F.lit(1))
    width = F.greatest(F.least(effective_dimensions(F.col("dimensions")), native.cast("long")), F.lit(1))
    return F.coalesce(F.size("payloads"), F.lit(0)).cast("long") * width * 8 <= row_bytes


def first_failures(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed requests of long-form ``outcomes`` and the vectors of all others.

    ``outcomes`` is what ``encode_request_texts`` gives. It is read several times, so pass a
    stored table. One failed payload fails its request, with the error of the lowest
    ``error_rank`` and then of the lowest payload index.

    Only failed rows are aggregated, and their order is one number, so this is a plain hash
    aggregate that combines before its shuffle. Up to ``FEW_REQUESTS`` failed requests are
    broadcast and no vector is shuffled. Beyond that, payload rows are matched by
    ``(request_id, slice)``, at most ``SLICE_ROWS`` rows per key however large a request.
    """
    rank = F.col("error_rank")
    # indexes start at NO_LIST
    order = rank.cast("long") * F.lit(1 << 40) + F.col("payload_index").cast("long") - NO_LIST
    failed = materialize(
        outcomes.where(rank.isNotNull())
        .groupBy("request_id")
        .agg((F.min(order) % (1 << 40) + NO_LIST).alias("payload_index")),
        "failed",
    )
    few = failed.count() <= FEW_REQUESTS
    failures = (
        outcomes.where(rank.isNotNull())
        .withColumn("payload_index", F.col("payload_index").cast("long"))
        .join(F.broadcast(failed) if few else failed, ["request_id", "payload_index"])
        .select("request_id", "model", "error.status", "error.detail", "error.kind")
    )
    good = outcomes.where(rank.isNull())
    if few:
        ids = F.broadcast(failed.select("request_id"))
        return failures, good.join(ids, "request_id", "left_anti").drop("error", "error_rank")
    slices = (
        _sliced(outcomes)
        .select("request_id", "_slice")
        .distinct()
        .join(failed.select("request_id"), "request_id", "left_semi")
    )
    vectors = _sliced(good).join(slices, ["request_id", "_slice"], "left_anti")
    return failures, vectors.drop("_slice", "error", "error_rank")


def _sliced(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_slice", int_div(F.greatest("payload_index", F.lit(0)), SLICE_ROWS))


def regroup_responses(vectors: DataFrame, part_texts: int = 1024) -> DataFrame:
    """Long-form vectors back to lists in payload order.

    A request of up to ``part_texts`` payloads is one row (``part`` 0); a larger one
    continues in further parts, so that no row or task holds an unbounded request. A request
    with an empty list has part 0 with no vectors.
    """
    part = int_div(F.greatest("payload_index", F.lit(0)), part_texts)
    item = F.when(F.col("payload_index") >= 0, F.struct("payload_index", "embedding"))
    return (
        vectors.groupBy("request_id", part.alias("part"))
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select("request_id", "part", F.col("items.embedding").alias("embeddings"))
    )
