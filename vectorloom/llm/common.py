"""What the operators share: naming, row keys and Arrow stages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vectorloom.session import attach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_stage(
    df: DataFrame, function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers."""
    attach(df.sparkSession)
    return df.mapInArrow(function, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def text_key(text: Column) -> Column:
    """A 64-bit key of a text; together with the id it tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def by_decision(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """The rows of ``docs`` for which ``decisions`` has a row of the same id and text
    (``how="left_semi"``), or those for which it has none (``how="left_anti"``).

    ``decisions`` holds the columns ``id`` and ``key`` (:func:`text_key`); where it is a stored
    table of few rows, as rejections are, Spark broadcasts it and no text moves. A null id
    equals a null id. Every column of ``docs`` is kept and none is added.
    """
    wanted = decisions.select(
        F.col("id").isNull().alias("_none"), F.coalesce("id", F.lit(0)).alias("_id"), F.col("key").alias("_key")
    ).distinct()
    left = docs.alias("d")
    on = (
        (F.col(f"d.{id_col}").isNull() == F.col("w._none"))
        & (F.coalesce(F.col(f"d.{id_col}"), F.lit(0)) == F.col("w._id"))
        & (text_key(F.col(f"d.{text_col}")) == F.col("w._key"))
    )
    return left.join(wanted.alias("w"), on, how)
