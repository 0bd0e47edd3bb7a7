"""Binding an intermediate value inside a single column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def int_div(value: Column, by: int) -> Column:
    """Whole-number division of non-negative integers."""
    return F.call_function("div", value, F.lit(by))
