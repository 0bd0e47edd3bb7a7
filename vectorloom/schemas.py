"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# kind is that of the failed call (see OUTCOME), null for requests that made none.
ERROR = T.StructType(
    [
        T.StructField("status", T.IntegerType()),
        T.StructField("detail", T.StringType()),
        T.StructField("kind", T.StringType()),
    ]
)

# One row per request, the payloads kept together.
REQUEST = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("payloads", T.ArrayType(T.StringType())),
        T.StructField("dimensions", T.LongType()),
    ]
)

# One row per payload of a request.
REQUEST_TEXT = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("dimensions", T.LongType()),
        T.StructField("payload_index", T.LongType()),
        T.StructField("payload", T.StringType()),
    ]
)

# What one encoder call reports about a request: kind is ok, unavailable,
# rejected, tokenize, exception or missing (a null text, no call); code is the model's own status if it gave one.
OUTCOME = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("message", T.StringType()),
    ]
)
