"""Keeping a vector table up to date with its texts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectorloom.encoders import EncoderFactory
from vectorloom.functions.failures import classify_failure
from vectorloom.functions.validation import check_payloads
from vectorloom.operators.provenance import FEW_KEYS, matching, stale_keys
from vectorloom.plans.bulk import embed, model_text
from vectorloom.registry import DEFAULT_DIMENSIONS, REGISTRY, ModelFacts
from vectorloom.session import materialize
from vectorloom.sources.keyindex import ON as KEY, KeyIndex
from vectorloom.sources.sinks import VECTOR_LAYOUT

_KEYS = "id long, text_hash binary, run string, model string, build string, task string, dimensions int, ok int"
_FAILED = f"outcome struct<kind:string,code:int,message:string>, {_KEYS}"

# Texts per core up to which spreading them evenly is worth shuffling them.
FEW_TEXTS = 10_000


def seen_hash(text: Column, facts: ModelFacts, task: str, truncate: bool = True) -> Column:
    """The fingerprint stored next to a vector: of what the encoder sees, that is of the text
    with its prompt, cut to the context. An encoder that cuts by its own tokens sees the whole
    prompted text and the context limit."""
    seen = model_text(text, facts, task, truncate)
    return F.unhex(F.md5(seen if truncate else F.concat(F.lit(f"{facts.n_ctx}|"), seen)))


def _facts(model: str, registry: Sequence[ModelFacts]) -> ModelFacts:
    facts = {m.key: m for m in registry}.get(model)
    if facts is None:
        raise ValueError(f"unknown model {model!r}")
    return facts


def refresh(
    texts: DataFrame,
    path: str,
    model: str,
    task: str,
    dimensions: int = DEFAULT_DIMENSIONS,
    *,
    build: str | None = None,
    factory: EncoderFactory | None = None,
    registry: Sequence[ModelFacts] = REGISTRY,
    truncate: bool = True,
    **options,
) -> DataFrame:
    """Embed the ``(id, text)`` rows without a current vector and append them to ``path``.

    A vector is current if what the encoder sees of the text, and model, build, task and width
    are unchanged. So a changed prompt or context limit counts as a change of text, and nothing
    is mixed: each (model, build, task, width) is a folder of its own. Equal rows are embedded
    and stored once. Replaced and deleted texts leave their old vectors behind; readers take
    :func:`current_vectors`, and :func:`compact` writes those alone.

    The keys that the table holds are kept in buckets beside it (:class:`KeyIndex`, made in the
    first run, or from a table written without one), so those of the texts are shuffled once, into
    these buckets, and the stored ones never. A run that dies after its vectors were written is
    found by the next one, which does not embed them again.

    Every encoded row is written once, vectors to ``ok=1`` and failures to ``ok=0``.
    Returns ``id, status, detail`` of the texts that failed in this run; they stay stale and
    are tried again by the next one. A null text is a 422.
    """
    facts = _facts(model, registry)
    build = build or facts.default_build
    dimensions = min(dimensions, facts.native_dim)
    spark = texts.sparkSession
    space = {"model": model, "build": build, "task": task, "dimensions": dimensions}
    fingerprint = seen_hash(F.col("text"), facts, task, truncate).alias("text_hash")
    given = texts.where(F.col("text").isNotNull())
    hashed = given.select("id", "text", fingerprint)
    index = _open_index(spark, path, space)
    if not index.exists:
        # The first build of a space embeds everything: only repeated rows are looked for. Rows
        # are equal only if their ids are, and counting those reads no text.
        counted = materialize(texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "counted")
        todo = _once(hashed, counted, ["id"])
    else:
        keys = index.dealt(hashed.select(*KEY)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        stale = materialize(stale_keys(keys, index.table()), "stale")
        n_stale, cores = stale.count(), spark.sparkContext.defaultParallelism
        if n_stale <= FEW_KEYS:
            # The ids are broadcast: other texts need no fingerprint a second time.
            hashed = matching(given, stale, ["id"]).select("id", "text", fingerprint)
        todo = _once(matching(hashed, stale, [*KEY]), stale, [*KEY])
        if n_stale <= cores * FEW_TEXTS:
            # Few texts, perhaps all from a few input splits: deal them out evenly. More
            # texts keep every core busy as they are, and are not shuffled.
            todo = todo.repartition(cores)
    run = uuid.uuid4().hex
    encoded = embed(
        todo, "text", model, task, dimensions, keys=[*KEY],
        factory=factory, registry=registry, truncate=truncate, **options,
    )
    named = encoded.withColumns({c: F.lit(v) for c, v in space.items()} | {"run": F.lit(run)})
    good = F.when(F.col("outcome.kind") == "ok", 1).otherwise(0)
    index.begin(run)
    named.withColumn("ok", good).write.mode("append").partitionBy(*VECTOR_LAYOUT, "ok").parquet(path)

    index.finish(run, _stored_keys(spark, path, space).where(F.col("run") == run))

    written = spark.read.schema(_FAILED).parquet(path).where((F.col("run") == run) & (F.col("ok") == 0))
    failed = written.select("id", classify_failure(F.col("outcome"), F.lit(model)).alias("error"))
    missing = check_payloads(F.array("text"))
    empty = texts.where(F.col("text").isNull()).select("id", missing.alias("error"))
    return failed.unionByName(empty).select("id", "error.status", "error.detail")


def _once(rows: DataFrame, counted: DataFrame, on: Sequence[str]) -> DataFrame:
    """``rows`` with one of each ``(id, text_hash)``; a row with a null id equals no other.

    ``counted`` is stored and says how many rows ``n`` have the same ``on``. Where most rows are
    repeated, all meet in one shuffle, read once; otherwise the repeated ones alone, and no other text moves.
    """
    many = (F.col("n") > 1) & F.col("id").isNotNull()
    repeated = counted.where(many)
    total, copies, nameless = counted.agg(
        F.sum("n"), F.sum(F.when(many, F.col("n"))), F.count_if(F.col("id").isNull())
    ).first()
    if not copies:
        return rows
    if 2 * copies < total:
        rare = matching(rows, repeated, on).dropDuplicates([*KEY])
        return matching(rows, repeated, on, keep=False).unionByName(rare)
    rare = rows.where(F.col("id").isNotNull()).dropDuplicates([*KEY])
    return rare.unionByName(rows.where(F.col("id").isNull())) if nameless else rare


def _stored_keys(spark: SparkSession, path: str, space: dict[str, object]) -> DataFrame:
    """Keys and runs of the vectors of a space."""
    stored = spark.read.schema(_KEYS).parquet(path)
    for column, value in (space | {"ok": 1}).items():
        stored = stored.where(F.col(column) == value)
    return stored


def _open_index(spark: SparkSession, path: str, space: dict[str, object]) -> KeyIndex:
    """The key index of a space with what earlier runs left undone."""
    index = KeyIndex(spark, path, space)
    try:
        stored = _stored_keys(spark, path, space)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return index
    pending = index.pending()
    if not index.exists and not pending and not stored.isEmpty():
        index.add(stored)  # a table that was written without an index
    for run in pending:
        index.finish(run, stored.where(F.col("run") == run))
    return index


def current_vectors(
    texts: DataFrame, vectors: DataFrame, *, model: str, build: str, task: str, dimensions: int,
    registry: Sequence[ModelFacts] = REGISTRY, truncate: bool = True,
) -> DataFrame:
    """The vectors of one space that belong to the texts as they are now."""
    space = {"model": model, "build": build, "task": task, "dimensions": dimensions, "ok": 1}
    for column, value in space.items():
        vectors = vectors.where(F.col(column) == value)
    fingerprint = seen_hash(F.col("text"), _facts(model, registry), task, truncate)
    wanted = texts.select("id", fingerprint.alias("text_hash")).distinct()
    return vectors.join(wanted, [*KEY], "left_semi")


def compact(texts: DataFrame, path: str, to: str, **space) -> None:
    """Write the current vectors of a space to the new table ``to``, without those of replaced
    and deleted texts and without failures."""
    vectors = texts.sparkSession.read.parquet(path)
    current_vectors(texts, vectors, **space).write.partitionBy(*VECTOR_LAYOUT, "ok").parquet(to)
