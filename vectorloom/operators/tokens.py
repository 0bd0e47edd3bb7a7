"""How many tokens texts take and what truncation costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from vectorloom.encoders.base import EncoderFactory
from vectorloom.functions.binding import let
from vectorloom.functions.prompts import apply_prompt
from vectorloom.functions.tokens import kept_tokens, may_overflow, plugin_token_counts, tokenize, windows
from vectorloom.operators.requests import route
from vectorloom.session import attach


def token_usage(
    rows: DataFrame, text: str = "payload", *, factory: EncoderFactory | None = None, **routing
) -> DataFrame:
    """Long-form rows with ``token_limit``, ``n_tokens``, ``kept_tokens`` and ``truncated``.

    Prompt and special tokens count. The text itself is not carried on; rows whose model
    is not active have nulls. Tokens are words, or with a ``factory`` of encoders that have a
    ``tokenize`` (``TokenEncoder``) those of each model, so that what is reported is what that
    encoder cuts.
    """
    return _counted(route(rows, **routing), rows, text, factory)


def truncations(
    rows: DataFrame, text: str = "payload", *, factory: EncoderFactory | None = None, **routing
) -> DataFrame:
    """The rows of :func:`token_usage` whose text is cut; short texts are not tokenised: two
    characters make at most one word, and a byte at most one token of a plug-in."""
    routed = route(rows, **routing)
    limit, special = F.col("token_limit"), F.col("n_special")
    if factory:
        long = F.octet_length(_prompted(text)) + special > limit
    else:
        long = may_overflow(_prompted(text), limit, special)
    return _counted(routed.where(long), rows, text, factory).where("truncated")


def document_windows(
    texts: DataFrame, text: str = "text", *, parts: int = 4, overlap: int = 0
) -> DataFrame:
    """One row per window of each text (see :func:`functions.tokens.windows`), as clients send
    them: the other columns, ``window``, ``start``, ``n_tokens`` and the window as ``text``.

    One pass without a shuffle; a text becomes a handful of rows, never one per word. Null texts
    and texts without words have no rows.
    """
    if parts < 1 or overlap < 0:
        raise ValueError("parts must be at least 1 and overlap at least 0")
    kept = [c for c in texts.columns if c != text]
    cut = windows(F.col(text), parts, overlap)
    return texts.select(*kept, F.explode(cut).alias("_w")).select(
        *kept, "_w.window", "_w.start", "_w.n_tokens", F.col("_w.text").alias(text)
    )


def _prompted(text: str) -> Column:
    return apply_prompt(F.col(text), F.col("task"), F.col("query_prompt"), F.col("document_prompt"))


def _counted(
    routed: DataFrame, rows: DataFrame, text: str, factory: EncoderFactory | None = None
) -> DataFrame:
    limit, special = F.col("token_limit"), F.col("n_special")
    if factory:
        # Counted by the encoder stage of its own, then read as a column: a function in Python
        # cannot stand inside a lambda.
        attach(routed.sparkSession)
        known = F.when(limit.isNotNull(), F.col("model"))
        routed = routed.withColumn("_n_tokens", plugin_token_counts(factory, known, _prompted(text)))

    def usage(n: Column) -> Column:
        kept = kept_tokens(n, limit, special)
        return F.struct(
            n.alias("n_tokens"), kept.alias("kept_tokens"), (kept < n).alias("truncated")
        )

    n = F.col("_n_tokens") if factory else F.size(tokenize(_prompted(text))) + special
    counted = let(n, usage)
    return routed.select(
        *[c for c in rows.columns if c != text], "token_limit", counted.alias("_usage")
    ).select("*", "_usage.*").drop("_usage")


def truncation_report(usage: DataFrame, *group: str) -> DataFrame:
    """Texts, truncated texts and lost tokens per group."""
    return usage.groupBy(*group).agg(*_totals())


def observe_truncation(usage: DataFrame, totals: Observation) -> DataFrame:
    """``usage`` as it is; the report on all of it is in ``totals`` once it was written, so a job
    that writes vectors from it need not count again."""
    return usage.observe(totals, *_totals())


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if("truncated").alias("n_truncated"),
        F.sum(F.col("n_tokens") - F.col("kept_tokens")).cast("long").alias("tokens_lost"),
    ]
