"""The registered queries: every operator on the given tables, over all their rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectorloom.functions.prompts import apply_prompt
from vectorloom.functions.sql import register_sql_functions
from vectorloom.functions.tokens import tokenize, truncate_tokens
from vectorloom.functions.validation import effective_dimensions
from vectorloom.functions.vectors import dot, finalize, l2_normalize
from vectorloom.operators.pooling import pool_last, pool_mean
from vectorloom.operators.provenance import canonical_builds, matching, space_guard, stale_keys
from vectorloom.operators.quality import (
    all_vectors_pass,
    long_count_checks,
    status_rollup,
    vector_checks,
)
from vectorloom.operators.requests import (
    only_active,
    regroup_responses,
    request_rows,
    route,
    validate_request_texts,
    validate_requests,
)
from vectorloom.operators.tokens import document_windows, token_usage, truncation_report, truncations
from vectorloom.plans.bulk import (
    embed,
    embed_request_texts,
    embed_requests,
    encode_request_texts,
    stand_in,
)
from vectorloom.plans.faults import FaultyFactory, PairFactory
from vectorloom.plans.refresh import current_vectors, refresh
from vectorloom.registry import GEMMA, REGISTRY, TASKS, models_table
from vectorloom.session import materialize, scratch_path, spread
from vectorloom.sources.requests import parse_requests
from vectorloom.sources.sinks import write_errors, write_responses, write_vectors
from vectorloom.sources.texts import read_texts
from vectorloom.streaming.jobs import (
    embed_lanes,
    embed_stream,
    embed_stream_with_dead_letters,
    read_request_stream,
)

# Byte values of a text's md5 that make the stand-in encoder fail, per kind of failure.
FAULT_RATE = 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents for work that is heavy per row, see :func:`spread`."""
    return spread(_table(spark, sf_dir, "documents").select(*columns))


def _checksum(vector: Column) -> Column:
    """A position-weighted sum of the components."""
    weighted = F.transform(vector, lambda x, i: x * (i + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda total, x: total + x)


def _digest(vector: Column) -> list[Column]:
    return [
        F.size(F.filter(vector, lambda x: x != 0)).cast("long").alias("nnz"),
        F.round(_checksum(vector), 6).alias("chk"),
    ]


# --- requests derived from the tables -------------------------------------------------


def _conversation_columns() -> dict[str, Column]:
    """Model, task and width of the request each conversation stands for."""
    conv = F.col("conv_id")
    model = F.when(conv % 5 <= 1, "gemma").when(conv % 5 <= 3, "qwen").otherwise("nomodel")
    width = F.floor(conv / 2) % 4
    return {
        "model": model,
        "task": F.when(conv % 2 == 0, "query").otherwise("document"),
        "dimensions": F.when(width == 1, 256).when(width == 2, 0).when(width == 3, 5000).cast("long"),
    }


def _conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one request per conversation, one payload per turn."""
    turns = spread(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return turns.withColumns(_conversation_columns()).select(
        F.col("conv_id").alias("request_id"), "model", "task", "dimensions",
        F.col("turn").alias("payload_index"), F.col("text").alias("payload"),
    )


def _turn_requests(turns: DataFrame) -> DataFrame:
    """Array form: one request per turn."""
    return turns.withColumns(_conversation_columns()).select(
        "conv_id", "turn", "model", "task", "dimensions", F.array("text").alias("payloads")
    )


def _document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array form: one request per document, its lines as payloads."""
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    return docs.select(
        F.col("doc_id").alias("request_id"),
        F.when(F.col("lang") == "en", "qwen").otherwise("gemma").alias("model"),
        F.lit("document").alias("task"),
        F.split("text", "\n").alias("payloads"),
        F.when(F.col("doc_id") % 3 == 1, 64).when(F.col("doc_id") % 3 == 2, 5).cast("long").alias("dimensions"),
    )


# --- embedding ------------------------------------------------------------------------


def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    vectors = embed(texts, "text", "gemma", "document", 256, double=True)
    return vectors.select(F.col("id").alias("doc_id"), *_digest(F.col("embedding")))


def embed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read_texts(spark, f"{sf_dir}/pages.parquet", "page_id", "html")
    vectors = embed(texts, "text", "qwen", "document", 1024, double=True)
    return vectors.select(F.col("id").alias("page_id"), *_digest(F.col("embedding")))


def embed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spread(_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    rows = items.select(
        F.col("item_id").alias("request_id"),
        F.explode(F.array(*[F.lit(m.key) for m in REGISTRY])).alias("model"),
        F.lit("query").alias("task"),
        F.lit(None).cast("long").alias("dimensions"),
        F.lit(0).cast("long").alias("payload_index"),
        F.col("text").alias("payload"),
    )
    encoded = encode_request_texts(rows, double=True)
    return encoded.select(
        F.col("request_id").alias("item_id"), "model", *_digest(F.col("embedding"))
    )


def embed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vectors = embed_request_texts(_conversation_requests(spark, sf_dir), double=True)
    return vectors.select(
        F.col("request_id").alias("conv_id"), F.col("payload_index").alias("turn"), "model", "build",
        F.size("embedding").cast("long").alias("dims"), *_digest(F.col("embedding")),
    )


def response_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = embed_requests(_document_requests(spark, sf_dir), double=True)
    lists = F.transform("embeddings", lambda v, j: _checksum(v) * (j % 5 + 1))
    return outcomes.select(
        F.col("request_id").alias("doc_id"),
        F.col("status").cast("long").alias("status"),
        F.size("embeddings").cast("long").alias("n_vectors"),
        F.size(F.col("embeddings")[0]).cast("long").alias("dims"),
        F.round(F.aggregate(lists, F.lit(0.0), lambda a, x: a + x), 5).alias("chk"),
    )


# --- vectors --------------------------------------------------------------------------


def truncate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = finalize(F.col("embedding"), F.lit(16))
    return (
        _table(spark, sf_dir, "embeddings")
        .select("vec_id", v.alias("v"))
        .select(
            "vec_id",
            F.size("v").cast("long").alias("dims"),
            F.array_join(F.transform("v", lambda x: F.round(x * 10_000).cast("long").cast("string")), ",").alias("spelled"),
        )
    )


def multi_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("vec_id") % 5
    width = (
        F.when(kind == 0, 1).when(kind == 1, 8).when(kind == 2, 32).when(kind == 3, 64).otherwise(5000)
    )
    v = finalize(F.col("embedding"), width)
    return (
        _table(spark, sf_dir, "embeddings")
        .select("vec_id", v.alias("v"))
        .select("vec_id", F.size("v").cast("long").alias("dims"), F.round(_checksum(F.col("v")), 6).alias("chk"))
    )


def default_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On vectors of 1,024 components (each stored one sixteen times over), so that the
    default of 768 is a cut."""
    asked = F.when(F.col("vec_id") % 2 == 1, 16).cast("long")
    v = finalize(F.flatten(F.array_repeat("embedding", 16)), effective_dimensions(asked))
    return (
        _table(spark, sf_dir, "embeddings")
        .select("vec_id", v.alias("v"))
        .select("vec_id", F.size("v").cast("long").alias("dims"), F.round(_checksum(F.col("v")), 5).alias("chk"))
    )


def dot_is_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    centres = pool_mean(vectors, "label", "embedding").select(
        "label", l2_normalize(F.col("pooled")).alias("centre")
    )
    # One stored row per label: broadcast if small, else a join adaptive execution can split.
    return vectors.join(materialize(centres, "centres"), "label").select(
        "vec_id", F.round(dot(l2_normalize(F.col("embedding")), F.col("centre")), 6).alias("cosine")
    )


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql_functions(spark)
    return spark.sql(
        """SELECT vec_id, size(v) AS dims, round(v[0], 6) AS x_first, round(l2_norm(v), 6) AS norm,
             round(dot_product(v, truncate_dims(embedding, 16)), 6) AS kept
           FROM (SELECT vec_id, embedding, finalize_vector(embedding, 16) AS v FROM {vectors})""",
        vectors=_table(spark, sf_dir, "embeddings"),
    ).withColumn("dims", F.col("dims").cast("long"))


def pool_mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pool_mean(_table(spark, sf_dir, "embeddings"), "label", "embedding")
    return pooled.select(
        F.col("label").cast("long").alias("label"),
        F.round(_checksum(finalize(F.col("pooled"), F.lit(64))), 6).alias("chk"),
    )


def pool_last_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pool_last(_table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return pooled.select(
        F.col("label").cast("long").alias("label"),
        F.round(_checksum(finalize(F.col("pooled"), F.lit(64))), 6).alias("chk"),
    )


# --- requests -------------------------------------------------------------------------


def prompted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = F.explode(
        F.array(
            *[F.struct(F.lit(m.key).alias("model"), F.lit(t).alias("task")) for m in REGISTRY for t in TASKS]
        )
    )
    docs = _documents(spark, sf_dir, "doc_id", "text").select("*", lanes.alias("lane"))
    routed = route(docs.select("doc_id", "text", "lane.model", "lane.task"))
    prompted = apply_prompt(F.col("text"), F.col("task"), F.col("query_prompt"), F.col("document_prompt"))
    return routed.select("doc_id", "model", "task", prompted.alias("p")).select(
        "doc_id", "model", "task", F.length("p").cast("long").alias("n_chars"), F.md5("p").alias("md5")
    )


def request_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_rows(_document_requests(spark, sf_dir))
    return rows.select(
        F.col("request_id").alias("doc_id"),
        F.col("payload_index").cast("long").alias("payload_index"),
        F.md5("payload").alias("md5"),
    )


def active_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = " qwen, ,gemma,qwen"
    served = only_active(_conversation_requests(spark, sf_dir), active)
    order = models_table(spark, active).select("ord", "model", "build", "token_limit")
    return (
        served.groupBy("model")
        .agg(F.count(F.lit(1)).alias("n_texts"))
        .join(F.broadcast(order), "model")
        .select(F.col("ord").cast("long").alias("ord"), "model", "build",
                F.col("token_limit").cast("long").alias("token_limit"), "n_texts")
    )


def _with_missing_payloads(rows: DataFrame) -> DataFrame:
    """Nulls in place of some payloads: the tables themselves have none."""
    hit = F.substring(F.md5("payload"), 1, 1) == "0"
    return rows.withColumn("payload", F.when(~hit, F.col("payload")))


def validate_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_missing_payloads(_conversation_requests(spark, sf_dir))
    return validate_request_texts(rows).select(
        F.col("request_id").alias("conv_id"),
        F.coalesce("error.status", F.lit(200)).cast("long").alias("status"),
        F.coalesce("error.detail", F.lit("")).alias("detail"),
    )


def json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with every kind of width and payload list, made from the turns."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    turns = turns.withColumns(_conversation_columns())
    kind, lists = F.col("turn") % 8, (F.col("conv_id") + F.col("turn")) % 6
    width = F.concat(
        F.lit(',"dimensions":'),
        F.when(kind == 1, "256").when(kind == 2, '"256"').when(kind == 3, "256.0").when(kind == 4, "256.5")
        .when(kind == 5, "null").when(kind == 6, "true").when(kind == 7, "0"),
    )
    text = F.to_json(F.array("text"))
    payloads = (
        F.when(lists == 1, "[]").when(lists == 2, F.to_json(F.struct("text"))).when(lists == 3, "[null]")
        .when(lists == 4, "[1]").otherwise(text)
    )
    line = F.concat(
        F.lit('{"request_id":'), F.col("conv_id").cast("string"),
        F.lit(',"model":"'), "model", F.lit('","task":"'), "task", F.lit('","payloads":'), payloads,
        F.coalesce(width, F.lit("")), F.when(lists != 5, "}").otherwise("")
    )
    parsed = parse_requests(turns.select("conv_id", "turn", line.alias("value")))
    checked = validate_requests(parsed, body_error=F.col("body_error"))
    return checked.select(
        "conv_id", "turn",
        F.coalesce("error.status", F.lit(200)).cast("long").alias("status"),
        F.coalesce("error.detail", F.lit("")).alias("detail"),
        F.when(F.col("error").isNull(), F.col("dimensions")).otherwise(-1).alias("dimensions"),
        F.when(F.col("error").isNull(), F.size("payloads").cast("long")).otherwise(-1).alias("n_payloads"),
    )


# --- tokens ---------------------------------------------------------------------------


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    n = F.size(tokenize(F.concat(F.lit(GEMMA.document_prompt), "text"))) + 2
    return docs.select("doc_id", n.cast("long").alias("n_tokens")).withColumn(
        "fits", F.col("n_tokens") <= GEMMA.n_ctx - 1
    )


def plugin_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plug-in's tokenizer makes of the documents, and what is lost of them: the encoder's
    own cut, counted per model."""
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    rows = docs.select(
        "doc_id", F.when(F.col("lang") == "en", "qwen").otherwise("gemma").alias("model"),
        F.lit("document").alias("task"), F.col("text").alias("payload"),
    )
    used = token_usage(rows, factory=PairFactory()).select(
        "doc_id", "model", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("kept_tokens").cast("long").alias("kept_tokens")
    )
    return used


def windows_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of each document's words at a time, without an overlap and with one."""
    docs = _documents(spark, sf_dir, "doc_id", "text")
    parts = [
        document_windows(docs, overlap=o).withColumn("overlap", F.lit(o).cast("long")) for o in (0, 8)
    ]
    return parts[0].unionByName(parts[1]).select(
        "doc_id", "overlap", *[F.col(c).cast("long").alias(c) for c in ("window", "start", "n_tokens")], F.md5("text").alias("digest")
    )


def truncated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [
        (model, n_ctx, prefix, suffix)
        for n_ctx in (64, 2048)
        for model, prefix, suffix in (("gemma", "<s>", "</s>"), ("qwen", None, "</s>"))
    ]

    def specials(token: str | None) -> Column:
        return F.array(*([F.lit(token)] if token else [])).cast("array<string>")

    variants = F.array(
        *[
            F.struct(
                F.lit(model).alias("model"), F.lit(n_ctx).alias("n_ctx"),
                specials(prefix).alias("prefix"), specials(suffix).alias("suffix"),
            )
            for model, n_ctx, prefix, suffix in cases
        ]
    )
    docs = _documents(spark, sf_dir, "doc_id", "text")
    words = docs.select("doc_id", tokenize(F.col("text")).alias("words"))
    return (
        words.select("doc_id", "words", F.explode(variants).alias("v"))
        .select("doc_id", "v.*", F.concat("v.prefix", "words", "v.suffix").alias("tokens"))
        .select(
            "doc_id", "model", F.col("n_ctx").cast("long").alias("n_ctx"),
            truncate_tokens(F.col("tokens"), F.col("n_ctx") - 1, F.col("prefix"), F.col("suffix")).alias("t"),
        )
        .select("doc_id", "model", "n_ctx", F.size("t").cast("long").alias("kept"),
                F.md5(F.array_join("t", " ")).alias("md5"))
    )


def truncation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = token_usage(_documents_per_model(spark, sf_dir), "text")
    return truncation_report(usage, "model", "lang")


def truncation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = truncations(_documents_per_model(spark, sf_dir), "text")
    counts = [F.col(c).cast("long").alias(c) for c in ("n_tokens", "kept_tokens", "token_limit")]
    return cut.select("doc_id", "model", *counts)


def _documents_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "doc_id", "text", "lang").select(
        "doc_id", "text", "lang", F.lit("document").alias("task"),
        F.explode(F.array(*[F.lit(m.key) for m in REGISTRY])).alias("model"),
    )


def regrouped_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversation_requests(spark, sf_dir).withColumn("dimensions", F.lit(8).cast("long"))
    rows = only_active(rows, "gemma,qwen")
    encoded = encode_request_texts(rows, normalize=False)
    spelled = F.transform("embeddings", lambda v: F.array_join(v.cast("array<int>"), ","))
    return regroup_responses(encoded, part_texts=4).select(
        F.col("request_id").alias("conv_id"), "part",
        F.size("embeddings").cast("long").alias("n_vectors"),
        F.md5(F.array_join(spelled, "|")).alias("md5"),
    )


# --- failures and checks --------------------------------------------------------------


def _faulty_outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _with_missing_payloads(_conversation_requests(spark, sf_dir))
    failures, vectors = embed_request_texts(rows, factory=FaultyFactory(stand_in(), FAULT_RATE))
    return rows, failures, vectors


def failure_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, failures, vectors = _faulty_outcomes(spark, sf_dir)
    good = vectors.groupBy("request_id").agg(F.count("embedding").alias("n_vectors"))
    return failures.select(
        F.col("request_id").alias("conv_id"), F.col("status").cast("long").alias("status"), "detail",
        F.lit(0).cast("long").alias("n_vectors"),
    ).unionByName(
        good.select(
            F.col("request_id").alias("conv_id"), F.lit(200).cast("long").alias("status"),
            F.lit("").alias("detail"), "n_vectors",
        )
    )


def long_form_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with lines, with an empty list and without a list, in both forms."""
    kind = F.col("request_id") % 5
    requests = _document_requests(spark, sf_dir).withColumn(
        "payloads", F.when(kind == 0, F.array().cast("array<string>")).when(kind != 1, F.col("payloads"))
    ).withColumn("dimensions", F.lit(8).cast("long"))
    array_form = embed_requests(requests).select(
        "request_id", F.lit("array").alias("form"), "status", F.coalesce(F.size("embeddings"), F.lit(0)).alias("n")
    )
    failures, vectors = embed_request_texts(request_rows(requests))
    lists = regroup_responses(vectors, part_texts=64)
    answered = lists.groupBy("request_id").agg(F.sum(F.size("embeddings")).alias("n"))
    long_form = answered.select("request_id", F.lit(200).alias("status"), "n").unionByName(
        failures.select("request_id", "status", F.lit(0).cast("long").alias("n"))
    )
    return array_form.unionByName(long_form.withColumn("form", F.lit("long"))).select(
        F.col("request_id").alias("doc_id"), "form", F.col("status").cast("long").alias("status"),
        F.greatest(F.col("n"), F.lit(0)).cast("long").alias("n_vectors"),
    )


def absent_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model does not load: its requests get a 503, those of the other their vectors."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    requests = _turn_requests(turns).where(F.col("model") != "nomodel").withColumn("dimensions", F.lit(4).cast("long"))
    outcomes = embed_requests(
        requests, keys=("conv_id", "turn"), factory=FaultyFactory(stand_in(), missing=("qwen",))
    )
    return outcomes.select(
        "conv_id", "turn", F.col("status").cast("long").alias("status"), F.coalesce("detail", F.lit("")).alias("detail"),
        F.coalesce(F.size("embeddings"), F.lit(0)).cast("long").alias("n_vectors"),
    )


def written_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as JSON lines, read back: two payloads per request, the item and its half."""
    items = spread(_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    half = F.left(F.col("text"), F.floor(F.length("text") / 2).cast("int"))
    requests = items.select(
        F.col("item_id").alias("request_id"),
        F.when(F.col("item_id") % 3 == 0, "gemma").when(F.col("item_id") % 3 == 1, "qwen").otherwise("nomodel").alias("model"),
        F.lit("query").alias("task"), F.array("text", half).alias("payloads"),
        F.lit(128).cast("long").alias("dimensions"),
    )
    path = scratch_path(spark, "responses")
    write_responses(embed_requests(requests, double=True), path)
    responses = spark.read.schema("request_id long, embeddings array<array<double>>").json(path)
    return responses.select(
        F.col("request_id").alias("item_id"), F.posexplode("embeddings").alias("position", "v")
    ).select("item_id", F.col("position").cast("long").alias("position"), *_digest(F.col("v")))


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _document_requests(spark, sf_dir)
    outcomes = embed_requests(requests, factory=FaultyFactory(stand_in(), 1))
    path = scratch_path(spark, "dead-letters")
    write_errors(outcomes, path)
    return spark.read.parquet(path).select(
        F.col("request_id").alias("doc_id"), F.col("status").cast("long").alias("status"), "detail"
    )


def validate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors are all good, so some are scaled, zeroed, spoilt or cut first."""
    kind, v = F.col("vec_id") % 10, F.col("embedding")
    changed = (
        F.when(kind == 0, F.transform(v, lambda x: x * 2))
        .when(kind == 1, F.transform(v, lambda x: F.lit(0).cast("float")))
        .when(kind == 2, F.transform(v, lambda x: F.lit("NaN").cast("float")))
        .when(kind == 3, F.slice(v, F.lit(1), F.lit(32)))
        .otherwise(v)
    )
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", changed.alias("v"))
    return vector_checks(rows, "v", 64).select("vec_id", "dim_ok", "norm_ok", "is_zero")


def vectors_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("embedding")
    return all_vectors_pass(vector_checks(rows, "embedding", 64))


def validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, vectors = _faulty_outcomes(spark, sf_dir)
    return long_count_checks(rows, vectors).withColumnRenamed("request_id", "conv_id")


def model_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, failures, vectors = _faulty_outcomes(spark, sf_dir)
    good = vectors.select("request_id", "model").distinct()
    outcomes = failures.select("model", "status", "kind").unionByName(
        good.select("model", F.lit(200).alias("status"), F.lit(None).cast("string").alias("kind"))
    )
    return status_rollup(outcomes).select("model", "file", "n_ok", "n_failed", "status", "healthy")


# --- provenance -----------------------------------------------------------------------

_ASKED = ("", "q4_k_m", "Q5_0", "q5_K_m", "q6_k", "q8_0", "F16", "q3", None)


def canonical_builds_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.element_at(F.array(*[F.lit(q) for q in _ASKED]), (F.col("doc_id") % len(_ASKED) + 1).cast("int"))
    exact = F.when(F.col("doc_id") % 2 == 1, "custom.gguf").otherwise("")
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return canonical_builds(docs, asked, exact).select("doc_id", "build", "build_error")


def mixed_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    asked = F.when((label % 4 == 3) & (F.col("vec_id") % 3 == 1), "q8_0").when(
        (label % 4 == 3) & (F.col("vec_id") % 3 == 2), "F16"
    )
    vectors = _table(spark, sf_dir, "embeddings").select(
        "vec_id", label.cast("long").alias("index_id"), asked.alias("asked"),
        F.when((label % 4 == 2) & (F.col("vec_id") % 2 == 0), "gemma").otherwise("qwen").alias("model"),
    )
    built = canonical_builds(vectors, F.col("asked"), F.lit(""))
    return space_guard(
        built.withColumn("build", F.when(F.col("model") == "qwen", F.col("build")).otherwise(GEMMA.default_build))
    )


def stale_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents stand for an earlier vector table: those of low quality were
    edited since, the toxic ones were made by another build."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    earlier = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.md5(F.concat("text", F.when(F.col("quality") == 1, "").otherwise(" "))).alias("text_hash"),
        F.lit("gemma").alias("model"),
        F.when(F.col("toxic") == 0, GEMMA.default_build).otherwise("other.gguf").alias("build"),
        F.lit(768).alias("dimensions"),
    )
    current = earlier.where((F.col("model") == "gemma") & (F.col("build") == GEMMA.default_build))
    keys = docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("text_hash")).distinct()
    stale = materialize(stale_keys(keys, current), "stale")
    texts = docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("text_hash"))
    return matching(texts, stale, ["id", "text_hash"]).select(F.col("id").alias("doc_id"), "text_hash")


def refreshed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector table for both tasks, made when the documents of low quality still had
    another text, then brought up to date for one task: there those have two vectors, of
    which one is current. Every row is given twice and stored once."""
    docs = _documents(spark, sf_dir, "doc_id", "text").withColumnRenamed("doc_id", "id")
    low = _table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    before = docs.join(low.distinct().withColumn("low", F.lit(True)), "id", "left").select(
        "id", F.when(F.col("low"), F.concat("text", F.lit(" old"))).otherwise(F.col("text")).alias("text")
    )
    path = scratch_path(spark, "refreshed")
    for texts, task in ((before, "query"), (before, "document"), (docs, "document")):
        refresh(texts.unionByName(texts), path, "gemma", task, 64, double=True)
    table = spark.read.parquet(path).where("ok = 1")
    space = {"model": "gemma", "build": GEMMA.default_build, "dimensions": 64}
    current = current_vectors(before, table, task="query", **space).unionByName(
        current_vectors(docs, table, task="document", **space)
    )
    one = F.lit(1).cast("long")
    return (
        table.select("id", "task", one.alias("stored"), F.lit(None).cast("double").alias("chk"))
        .unionByName(
            current.select("id", "task", F.lit(0).cast("long").alias("stored"), F.round(_checksum(F.col("embedding")), 5).alias("chk"))
        )
        .groupBy(F.col("id").alias("doc_id"), "task")
        .agg(F.sum("stored").alias("n_stored"), F.count("chk").alias("n_current"), F.max("chk").alias("chk"))
    )


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by model, build and width, then read back."""
    encoded = encode_request_texts(_conversation_requests(spark, sf_dir))
    path = scratch_path(spark, "vectors")
    good = encoded.where(F.col("error").isNull())
    write_vectors(good.select("request_id", "payload_index", "embedding", "model", "build", "task", "dimensions"), path)
    return (
        spark.read.parquet(path)
        .groupBy("model", "build", F.col("dimensions").cast("long").alias("dimensions"))
        .agg(
            F.count(F.lit(1)).alias("n_vectors"),
            F.min(F.size("embedding")).cast("long").alias("width"),
            F.sum(F.size(F.filter("embedding", lambda x: x != 0))).cast("long").alias("nnz"),
        )
    )


# --- streaming ------------------------------------------------------------------------

_TURN_SCHEMA = "conv_id bigint, turn bigint, role string, text string"
# What a micro-batch takes in: enough to keep every core busy, however many files that is.
_TRIGGER_BYTES = 256 * 2**20


def _turn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, one file or a folder of many, as a stream."""
    return read_request_stream(spark, f"{sf_dir}/conversations.parquet", _TURN_SCHEMA, bytes_per_trigger=_TRIGGER_BYTES)


def stream_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turn_stream(spark, sf_dir).select(
        F.col("conv_id").alias("request_id"), F.lit("gemma").alias("model"),
        F.lit("document").alias("task"), F.lit(256).cast("long").alias("dimensions"),
        F.col("turn").alias("payload_index"), F.col("text").alias("payload"),
    )
    out = scratch_path(spark, "stream")
    embed_stream(rows, f"{out}/vectors", f"{out}/checkpoint", double=True).awaitTermination()
    return spark.read.parquet(f"{out}/vectors").select(
        F.col("request_id").alias("conv_id"), F.col("payload_index").alias("turn"), *_digest(F.col("embedding"))
    )


def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "stream")
    embed_stream_with_dead_letters(
        _turn_requests(_turn_stream(spark, sf_dir)), out, f"{out}/checkpoint",
        keys=("conv_id", "turn"), factory=FaultyFactory(stand_in(), FAULT_RATE),
    ).awaitTermination()
    return spark.read.parquet(f"{out}/dead_letters").select(
        "conv_id", "turn", F.col("status").cast("long").alias("status"), "detail"
    )


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is delivered twice, in files of their own, and once more after a restart of
    the stream; each has one outcome."""
    out = scratch_path(spark, "stream")
    turns = _table(spark, sf_dir, "conversations")
    for again in (False, True):
        for _ in range(1 if again else 2):
            turns.write.mode("append").parquet(f"{out}/in")
        source = read_request_stream(spark, f"{out}/in", _TURN_SCHEMA, files_per_trigger=1)
        embed_stream_with_dead_letters(
            _turn_requests(source), out, f"{out}/checkpoint",
            keys=("conv_id", "turn"), factory=FaultyFactory(stand_in(), FAULT_RATE),
        ).awaitTermination()
    return (
        spark.read.parquet(f"{out}/outcomes").groupBy("conv_id", "turn")
        .agg(F.count(F.lit(1)).alias("n_outcomes"), F.max(F.col("status").cast("long")).alias("status"))
    )


def stream_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness of every model from a stream that counts while it writes; one model does not load."""
    out = scratch_path(spark, "stream")
    embed_stream_with_dead_letters(
        _turn_requests(_turn_stream(spark, sf_dir)), out, f"{out}/checkpoint",
        keys=("conv_id", "turn"), factory=FaultyFactory(stand_in(), missing=("qwen",)),
    ).awaitTermination()
    rows = spark.read.parquet(f"{out}/readiness")
    return rows.groupBy("model").agg(
        F.sum("n_ok").alias("n_ok"), F.sum("n_failed").alias("n_failed"),
        F.max(F.when(F.col("n_failed") > 0, F.col("status"))).alias("failed_as"),
    )


def stream_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as queries and as documents, in streams side by side; some answers exceed a row of
    the size given here and come in parts."""
    out = scratch_path(spark, "stream")
    turns = _turn_stream(spark, sf_dir).select(
        "conv_id", "turn", F.lit("gemma").alias("model"),
        F.when(F.col("role") == "user", "query").otherwise("document").alias("task"),
        F.array_repeat("text", (F.col("turn") % 3 + 1).cast("int")).alias("payloads"),
        F.lit(16).cast("long").alias("dimensions"),
    )
    lanes = embed_lanes(
        turns, out, f"{out}/checkpoint", keys=("conv_id", "turn"), row_bytes=2 * 16 * 8,
        pool="{lane}" if spark.sparkContext.getConf().get("spark.scheduler.mode", "FIFO") == "FAIR" else None,
    )
    for lane in lanes.values():
        lane.awaitTermination()
    answers = [
        spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/{lane}/{table}")
        .select("conv_id", "turn", F.lit(lane).alias("lane"), F.lit(table).alias("place"), F.size("embeddings").alias("n"))
        for lane in lanes
        for table, schema in (("outcomes", _LANE_ROW), ("response_parts", _LANE_ROW))
    ]
    return (
        reduce(DataFrame.unionByName, answers).where("n >= 0").groupBy("conv_id", "turn", "lane", "place")
        .agg(F.sum("n").cast("long").alias("n_vectors"))
    )


_LANE_ROW = "conv_id bigint, turn bigint, embeddings array<array<float>>"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "embed_documents": embed_documents,
    "embed_pages": embed_pages,
    "embed_queries": embed_queries,
    "embed_conversations": embed_conversations,
    "response_lists": response_lists,
    "truncate_normalize": truncate_normalize,
    "multi_width": multi_width,
    "default_width": default_width,
    "dot_is_cosine": dot_is_cosine,
    "sql_functions": sql_functions,
    "pool_mean": pool_mean_by_label,
    "pool_last": pool_last_by_label,
    "prompted_texts": prompted_texts,
    "request_rows": request_payloads,
    "active_requests": active_requests,
    "validate_requests": validate_conversations,
    "json_requests": json_requests,
    "token_counts": token_counts,
    "plugin_tokens": plugin_tokens,
    "document_windows": windows_of_documents,
    "truncate_tokens": truncated_tokens,
    "truncation_report": truncation_totals,
    "truncation_log": truncation_log,
    "regroup_responses": regrouped_responses,
    "failure_isolation": failure_isolation,
    "long_form_requests": long_form_requests,
    "absent_model": absent_model,
    "written_responses": written_responses,
    "dead_letters": dead_letters,
    "validate_vectors": validate_vectors,
    "vectors_pass": vectors_pass,
    "validate_counts": validate_counts,
    "status_rollup": model_status,
    "canonical_build": canonical_builds_of_documents,
    "space_guard": mixed_spaces,
    "stale_vectors": stale_documents,
    "refresh_vectors": refreshed_vectors,
    "vector_table": vector_table,
    "stream_embed": stream_embed,
    "stream_dead_letters": stream_dead_letters,
    "stream_once": stream_once,
    "stream_readiness": stream_readiness,
    "stream_lanes": stream_lanes,
}
