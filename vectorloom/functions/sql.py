"""The vector expressions as SQL functions.

They are SQL functions in the engine's sense: their bodies are inlined into the plan, no
Python runs. A norm is bound once per vector, as in :mod:`vectorloom.functions.vectors`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_DEFINITIONS = (
    """truncate_dims(v ARRAY<DOUBLE>, d BIGINT) RETURNS ARRAY<DOUBLE>
       RETURN slice(v, 1, cast(least(size(v), d) AS INT))""",
    """l2_norm(v ARRAY<DOUBLE>) RETURNS DOUBLE
       RETURN sqrt(aggregate(v, 0D, (total, x) -> total + x * x))""",
    """l2_normalize(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>
       RETURN element_at(transform(array(sqrt(aggregate(v, 0D, (total, x) -> total + x * x))),
         n -> transform(v, x -> CASE WHEN n > 0 AND NOT isnan(n) THEN x / n ELSE 0D END)), 1)""",
    """dot_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
       RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (total, x) -> total + x)""",
    """finalize_vector(v ARRAY<DOUBLE>, d BIGINT) RETURNS ARRAY<DOUBLE>
       RETURN l2_normalize(truncate_dims(v, d))""",
)


def register_sql_functions(spark: SparkSession) -> None:
    """``truncate_dims``, ``l2_norm``, ``l2_normalize``, ``dot_product`` and
    ``finalize_vector`` for this session."""
    for definition in _DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
