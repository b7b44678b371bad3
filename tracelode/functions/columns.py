"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounding to the even neighbour on a tie."""
    return F.bround(value, digits)


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    """``part / whole`` rounded half to even; null where ``whole`` is zero."""
    return half_even(F.try_divide(part.cast("double"), whole.cast("double")), digits)
