"""Bulk text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vectorloom.session import spread


def read_texts(spark: SparkSession, path: str, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` of a Parquet table; only these two columns are read."""
    return spread(
        spark.read.parquet(path).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    )
