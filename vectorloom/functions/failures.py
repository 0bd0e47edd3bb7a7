"""From what an encoder call reported to the status and message a caller gets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vectorloom.schemas import ERROR

# The wording of the messages callers see.
UNAVAILABLE = " model server unavailable: "
TOKENIZE_FAILED = ": tokenize failed: "


def classify_failure(outcome: Column, model: Column) -> Column:
    """``struct<status, detail, kind>`` for a failed outcome, null for a good one.

    A model that cannot be reached, or says 503 itself, is 503; every other refusal,
    a failed tokenisation and any unexpected exception are 500.
    """
    kind, code, message = outcome["kind"], outcome["code"], outcome["message"]
    unavailable = F.concat(model, F.lit(UNAVAILABLE), message)
    tokenize = F.concat(model, F.lit(TOKENIZE_FAILED), message)
    rejected = F.concat(model, F.lit(": "), message)
    status = (
        F.when(kind == "unavailable", 503)
        .when(kind == "missing", 422)
        .when((kind == "rejected") & (code == 503), 503)
        .otherwise(500)
    )
    detail = (
        F.when(kind == "unavailable", unavailable)
        .when(kind == "tokenize", tokenize)
        .when(kind == "rejected", rejected)
        .otherwise(message)
    )
    return F.when(
        kind != "ok", F.struct(status.alias("status"), detail.alias("detail"), kind.alias("kind"))
    ).cast(ERROR)
