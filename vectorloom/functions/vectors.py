"""Vector expressions over ``ARRAY<FLOAT>`` / ``ARRAY<DOUBLE>`` columns.

Sums run in double. A value that a lambda reads repeatedly is bound once through
``let``: a plain reference would be evaluated again for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vectorloom.functions.binding import let


def truncate_dims(vector: Column, dimensions: Column) -> Column:
    """The first ``dimensions`` components; all of them if there are fewer."""
    size = F.least(F.size(vector).cast("long"), dimensions.cast("long")).cast("int")
    return F.slice(vector, F.lit(1), size)


def l2_norm(vector: Column) -> Column:
    """Euclidean length, in double."""
    return F.sqrt(
        F.aggregate(
            vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
        )
    )


def l2_normalize(vector: Column) -> Column:
    """Scale to length 1, as ``ARRAY<DOUBLE>``.

    A zero vector, and one holding a NaN, becomes all zeros. The NaN test is explicit
    because SQL orders NaN above every number.
    """

    def scale(norm: Column) -> Column:
        usable = (norm > 0) & ~F.isnan(norm)
        return F.transform(vector, lambda x: F.when(usable, x.cast("double") / norm).otherwise(0.0))

    return let(l2_norm(vector), scale)


def finalize(vector: Column, dimensions: Column) -> Column:
    """Cut to ``dimensions``, then scale what is left to length 1."""
    return let(truncate_dims(vector, dimensions), l2_normalize)


def dot(left: Column, right: Column) -> Column:
    """Inner product in double; the cosine if both sides have length 1."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
