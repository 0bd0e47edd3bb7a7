"""Facts about the models, and the tables made from them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class ModelFacts:
    """One embedding model; add an entry to a registry to support another."""

    key: str
    name: str
    repo: str
    default_build: str
    native_dim: int
    query_prompt: str
    document_prompt: str
    pooling: str
    n_ctx: int
    start_tokens: int
    end_tokens: int


# They decide which vectors come out, so they are part of the contract.
DEFAULT_DIMENSIONS = 768
GEMMA = ModelFacts(
    key="gemma",
    name="google/embeddinggemma-300m",
    repo="ggml-org/embeddinggemma-300M-GGUF",
    default_build="embeddinggemma-300M-Q8_0.gguf",
    native_dim=768,
    query_prompt="task: search result | query: ",
    document_prompt="title: none | text: ",
    pooling="mean",
    n_ctx=2048,
    start_tokens=1,
    end_tokens=1,
)
QWEN = ModelFacts(
    key="qwen",
    name="Qwen/Qwen3-Embedding-8B",
    repo="Qwen/Qwen3-Embedding-8B-GGUF",
    default_build="Qwen3-Embedding-8B-Q4_K_M.gguf",
    native_dim=4096,
    query_prompt=(
        "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: "
    ),
    document_prompt="",
    pooling="last",
    n_ctx=8192,
    start_tokens=0,
    end_tokens=1,
)
QWEN_QUANTS = ("Q4_K_M", "Q5_0", "Q5_K_M", "Q6_K", "Q8_0", "f16")
QWEN_BUILD_FORMAT = ("Qwen3-Embedding-8B-", ".gguf")
TASKS = ("document", "query")

REGISTRY: tuple[ModelFacts, ...] = (GEMMA, QWEN)

# Registry tables are broadcast. They hold one row per supported model and come from
# code, not from data; this bound is checked when the table is made.
MAX_MODELS = 256


def parse_active(value: str | Iterable[str], registry: Sequence[ModelFacts] = REGISTRY) -> list[str]:
    """The models a job serves, from ``"gemma,qwen"`` or a list.

    Blank entries are dropped and repeats keep their first place. An unknown name,
    or no name at all, stops the job.
    """
    wanted: list[str] = []
    for entry in value.split(",") if isinstance(value, str) else value:
        key = entry.strip()
        if key and key not in wanted:
            wanted.append(key)
    known = [facts.key for facts in registry]
    if not wanted or not set(wanted) <= set(known):
        raise ValueError(f"model list {wanted} must name at least one of {known} and nothing else")
    return wanted


def resolve_build(override: Column, default_build: Column) -> Column:
    """The build in use: the override unless it is null or empty."""
    return F.coalesce(F.nullif(override, F.lit("")), default_build)


def models_table(
    spark: SparkSession,
    active: str | Iterable[str] | None = None,
    overrides: Mapping[str, str] | None = None,
    registry: Sequence[ModelFacts] = REGISTRY,
) -> DataFrame:
    """One row per active model, ``ord`` giving the configured order.

    A literal relation: Catalyst folds it into the plan, nothing is shipped as a file.
    """
    keys = [m.key for m in registry] if active is None else parse_active(active, registry)
    if len(keys) > MAX_MODELS:
        raise ValueError(f"at most {MAX_MODELS} models can be active, got {len(keys)}")
    by_key = {m.key: m for m in registry}
    overrides = overrides or {}
    rows, args = [], {}
    for position, key in enumerate(keys):
        m = by_key[key]
        cells = [
            position, m.key, m.name, m.repo, m.default_build, overrides.get(key) or "", m.native_dim,
            m.query_prompt, m.document_prompt, m.pooling, m.n_ctx, m.start_tokens, m.end_tokens,
        ]
        names = [f"m{position}_{i}" for i in range(len(cells))]
        rows.append("(" + ", ".join(f":{name}" for name in names) + ")")
        args.update(zip(names, cells))
    table = spark.sql(
        "SELECT * FROM VALUES " + ", ".join(rows) + " AS m(ord, model, name, repo, default_build,"
        " build_override, native_dim, query_prompt, document_prompt, pooling, n_ctx,"
        " start_tokens, end_tokens)",
        args=args,
    )
    return table.select(
        "ord", "model", "name", "repo", "default_build",
        resolve_build(F.col("build_override"), F.col("default_build")).alias("build"),
        "native_dim",
        F.least(F.lit(DEFAULT_DIMENSIONS), F.col("native_dim")).alias("default_dim"),
        "query_prompt", "document_prompt", "pooling", "n_ctx",
        (F.col("n_ctx") - 1).alias("token_limit"),
        "start_tokens", "end_tokens",
    )


def quants_table(spark: SparkSession) -> DataFrame:
    """The published quantisations, keyed by their lower-case spelling."""
    head, tail = QWEN_BUILD_FORMAT
    names = F.explode(F.array(*[F.lit(q) for q in QWEN_QUANTS])).alias("quant")
    return spark.range(1).select(names).select(
        F.lower("quant").alias("quant_key"),
        "quant",
        F.concat(F.lit(head), "quant", F.lit(tail)).alias("quant_build"),
    )
