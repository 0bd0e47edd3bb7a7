"""Token vectors to one vector per text."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F


def pool_mean(tokens: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """The mean of each key's vectors.

    One mutable vector per key and task, combined before the shuffle: neither exploded
    components nor a key's full set of vectors are ever shuffled.
    """
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return tokens.groupBy(key).agg(vector_to_array(mean).alias("pooled"))


def pool_last(
    tokens: DataFrame, key: str, position: str = "token_index", vector: str = "vector"
) -> DataFrame:
    """The vector at each key's highest position; a position occurs once per key.

    The highest position is a number, so it is found by a hash aggregate that combines within
    tasks. Vectors are then looked up by key and position, and never sorted.
    """
    last = tokens.groupBy(F.col(key).alias("_key")).agg(F.max(position).alias("_last"))
    here = F.col(key).eqNullSafe(F.col("_key")) & (F.col(position) == F.col("_last"))
    return tokens.join(last.hint("shuffle_hash"), here).select(key, F.col(vector).alias("pooled"))
