"""Request checks as nullable ``struct<status, detail, kind>`` columns; null means fine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vectorloom.registry import DEFAULT_DIMENSIONS, TASKS
from vectorloom.schemas import ERROR


def error(status: int, detail: Column | str) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    none = F.lit(None).cast("string")
    return F.struct(F.lit(status).alias("status"), text.alias("detail"), none.alias("kind")).cast(ERROR)


def effective_dimensions(dimensions: Column) -> Column:
    """The requested width, or the default where none was given."""
    return F.coalesce(dimensions, F.lit(DEFAULT_DIMENSIONS).cast("long"))


def check_dimensions(dimensions: Column) -> Column:
    """422 for a width below 1; null counts as "not given"."""
    return F.when(
        effective_dimensions(dimensions) < 1,
        error(422, "dimensions: input should be greater than or equal to 1"),
    )


def check_payloads(payloads: Column) -> Column:
    """422 unless the payloads are a list of strings; the empty string is fine."""
    return F.when(
        payloads.isNull(), error(422, "payloads: input should be a valid list")
    ).when(
        F.exists(payloads, lambda p: p.isNull()),
        error(422, "payloads: every item should be a valid string"),
    )


def missing_route(model: Column, task: Column) -> Column:
    """404 where model and task do not form an address at all."""
    no_model = model.isNull() | (model == "") | F.contains(model, F.lit("/"))
    no_task = task.isNull() | ~task.isin(*TASKS)
    return F.when(no_model | no_task, error(404, "Not Found"))


def quoted(name: Column) -> Column:
    """A name in quotes: single ones unless only the name itself contains those."""
    escaped = F.replace(name, F.lit("\\"), F.lit("\\\\"))
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    for char in [*map(chr, range(32)), "\x7f"]:
        spelled = named.get(char, f"\\x{ord(char):02x}")
        escaped = F.replace(escaped, F.lit(char), F.lit(spelled))
    single, double = F.contains(name, F.lit("'")), F.contains(name, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def unknown_model(model: Column, is_active: Column, active: list[str]) -> Column:
    """404 for a name outside the active models, listing those in configured order."""
    detail = F.concat(
        F.lit("Unknown model "), quoted(model), F.lit("; available: " + ", ".join(active))
    )
    return F.when(~is_active, error(404, detail))


def request_error(
    model: Column,
    task: Column,
    is_active: Column,
    active: list[str],
    *body_errors: Column,
) -> Column:
    """The one error a request reports.

    An address that does not exist comes first, then what is wrong with the body, then
    a model that is not active. A body that could not be read at all, with the address in
    it, is not a wrong address.
    """
    unread = [
        F.when(model.isNull() & task.isNull() & F.startswith(e["detail"], F.lit("body: ")), e) for e in body_errors
    ]
    return F.coalesce(
        *unread, missing_route(model, task), *body_errors, unknown_model(model, is_active, active)
    )
