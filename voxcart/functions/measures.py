"""Time differences, windows to an instant, vector distance and similarity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(value: Column | datetime | str | None) -> Column:
    """``as_of`` argument as a timestamp column; None means now."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    # As text, so that the session zone applies and not the driver machine's.
    return F.lit(str(value)).cast("timestamp")


def whole_minutes(start: Column, end: Column) -> Column:
    """Whole minutes from ``start`` to ``end``, cut towards zero."""
    return F.timestamp_diff("MINUTE", start, end)


def hours_since(start: Column, as_of: Column) -> Column:
    return F.round(whole_minutes(start, as_of) / F.lit(60.0), 2)


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL '{int(days)}' DAY")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two ``array<double>`` columns; NULL if either has no length."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms > 0, _dot(a, b) / norms)
