"""Which model and build made a vector, and which vectors are out of date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vectorloom.registry import QWEN, quants_table, resolve_build

SPACE = ("model", "build")


def canonical_builds(
    df: DataFrame, quant: Column, exact_build: Column, default_build: str = QWEN.default_build
) -> DataFrame:
    """``df`` with ``build`` and ``build_error``.

    A quantisation name, matched without regard to case, wins over an exact build name,
    which wins over the default. A name that is not published is an error, not a default.
    """
    asked = F.nullif(quant, F.lit(""))
    quants = F.broadcast(quants_table(df.sparkSession))
    return (
        df.withColumns(
            {"_quant": asked, "_quant_key": F.lower(asked), "_exact": F.nullif(exact_build, F.lit(""))}
        )
        .join(quants, F.col("_quant_key") == F.col("quant_key"), "left")
        .withColumns(
            {
                "build": F.when(F.col("_quant").isNotNull(), F.col("quant_build")).otherwise(
                    resolve_build(F.col("_exact"), F.lit(default_build))
                ),
                "build_error": F.when(
                    F.col("_quant").isNotNull() & F.col("quant").isNull(),
                    F.concat(F.lit("unknown quantisation "), "_quant"),
                ),
            }
        )
        .drop("_quant", "_quant_key", "_exact", "quant_key", "quant", "quant_build")
    )


def space_guard(vectors: DataFrame, index: str = "index_id") -> DataFrame:
    """Per index the number of (model, build) spaces in it; more than one is ``mixed``.

    Reduces to the distinct spaces per index within each task first, so an index holding
    most of the rows costs no more to shuffle than any other.
    """
    return (
        vectors.select(index, *SPACE)
        .distinct()
        .groupBy(index)
        .agg(F.count(F.lit(1)).alias("n_spaces"))
        .withColumn("mixed", F.col("n_spaces") > 1)
    )


# Keys that are broadcast: an id and a 16-byte fingerprint each, some 50 MB in all.
FEW_KEYS = 1_000_000


def stale_keys(keys: DataFrame, current: DataFrame, on: Sequence[str] = ("id", "text_hash")) -> DataFrame:
    """The rows of ``keys`` without a vector in ``current``, the vectors of one space.

    Only ids and fingerprints are read. If ``current`` is a key index and ``keys`` are dealt into
    its buckets, neither is shuffled for the join.
    """
    return keys.join(current.select(*on), list(on), "left_anti")


def matching(rows: DataFrame, keys: DataFrame, on: Sequence[str], keep: bool = True) -> DataFrame:
    """The rows whose key is in the stored table ``keys`` (with ``keep=False``, is not).

    Up to ``FEW_KEYS`` keys (counted) are broadcast, so no row moves; more are joined by a shuffle,
    which adaptive execution can split.
    """
    wanted = keys.select(*on).distinct()
    if keys.count() <= FEW_KEYS:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, list(on), "left_semi" if keep else "left_anti")
