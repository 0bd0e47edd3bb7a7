"""Request tables and JSON request lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectorloom.functions.validation import error as refusal
from vectorloom.schemas import REQUEST

# Strings of any length; the parser's own default refuses those over 20 MB.
_ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


# Fixed value: the largest variant that Spark makes.
VARIANT_BYTES = 128 << 20

def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Array-form requests from Parquet. A null width means "not given" here."""
    return spark.read.schema(REQUEST).parquet(path)


def read_json_requests(spark: SparkSession, path: str, **route: str) -> DataFrame:
    """Array-form requests from JSON lines, with the column ``body_error``."""
    return parse_requests(spark.read.text(path), "value", **route)


def parse_requests(
    lines: DataFrame, column: str = "value", *, model: str | None = None, task: str | None = None,
    require_id: bool = True,
) -> DataFrame:
    """Parse one JSON request per row; never fails the job. Works on streams as well.

    ``model`` and ``task`` address all lines; without them each line names its own.

    One parser reads lines of every length. Parsing through a variant keeps what a declared schema would lose: a width that is
    absent from one that is null, and a string from a number. A width may also be given
    as an integral float, a string holding an integer, or a boolean, and is refused
    otherwise. What cannot be accepted is a 422 in ``body_error``, and the text itself is then
    in ``request_line``, so that it can be found again. A line beyond Spark's limit for one
    variant (``VARIANT_BYTES``) is refused with that as its reason. A request without an integer ``request_id`` is
    a 422 unless ``require_id`` is false, for lines that are told apart by other columns.
    """
    value = F.col(column)
    # As the only item of an array: an option then lifts the length limit, and anything behind
    # the value, or a second one, makes the line invalid.
    items = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<variant>", _ANY_LENGTH)
    parsed = lines.withColumn("_items", items)
    parsed = parsed.withColumn("_body", F.when(F.size("_items") == 1, F.get("_items", F.lit(0))))

    def member(name: str, kind: str) -> Column:
        return F.try_variant_get(F.col("_body"), f"$.{name}", kind)

    def address(name: str, given: str | None) -> Column:
        return (member(name, "string") if given is None else F.lit(given)).alias(name)

    payloads, width = member("payloads", "variant"), member("dimensions", "variant")
    parsed = parsed.withColumns(
        {
            "_payloads_type": F.schema_of_variant(payloads),
            "_width_type": F.schema_of_variant(width),
            "_width_text": F.trim(member("dimensions", "string")),
        }
    )
    listed = F.col("_payloads_type").isin("ARRAY<STRING>", "ARRAY<VOID>")
    text, kind = F.col("_width_text"), F.col("_width_type")
    number = (
        F.when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0).cast("double"))
        .when((kind == "STRING") & text.rlike(r"^[+-]?\d+(\.0*)?$"), text.try_cast("double"))
        .when((kind != "STRING") & (kind != "VOID"), text.try_cast("double"))
    )
    # Wider than any vector is the same as the widest, so the exact value does not matter.
    bounded = F.when(number.isNotNull(), F.greatest(F.least(number, F.lit(1e15)), F.lit(-1e15)))
    integral = bounded.isNotNull() & (bounded == F.floor(bounded))
    broken = F.col("_body").isNull()
    too_long = broken & (F.octet_length(value) > VARIANT_BYTES)
    not_object = ~F.startswith(F.schema_of_variant(F.col("_body")), F.lit("OBJECT"))
    error = (
        F.when(too_long, refusal(422, f"body: a line of more than {VARIANT_BYTES >> 20} MiB cannot be read as one value"))
        .when(broken, refusal(422, "body: JSON decode error"))
        .when(not_object, refusal(422, "body: input should be a valid dictionary"))
        .when(
            kind.isNotNull() & ~F.coalesce(integral, F.lit(False)),
            refusal(422, "dimensions: input should be a valid integer"),
        )
        .when(
            F.col("_payloads_type").startswith("ARRAY") & ~listed,
            refusal(422, "payloads: every item should be a valid string"),
        )
    )
    whole = F.trim(member("request_id", "string")).rlike(r"^[+-]?\d+$")
    request_id = F.when(whole, member("request_id", "bigint"))
    if require_id:
        no_id = refusal(422, "request_id: input should be a valid integer")
        error = F.coalesce(error, F.when(request_id.isNull(), no_id))
    return parsed.select(
        *[c for c in lines.columns if c not in (column, "request_line")],
        request_id.alias("request_id"),
        address("model", model),
        address("task", task),
        F.when(listed, member("payloads", "array<string>")).alias("payloads"),
        bounded.cast("long").alias("dimensions"),
        error.alias("body_error"),
        F.when(error.isNotNull(), value).alias("request_line"),
    )
