"""Missing-value policy: NaN and infinities become NULL at ingest, NULL inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL for NaN and infinities, the value otherwise."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def ratio(a: Column, b: Column) -> Column:
    """Division that gives NULL instead of raising when the denominator is zero."""
    return F.try_divide(a, b)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clamp, keeping NULL (``least``/``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def within(c: Column, lo: float | None, hi: float | None) -> Column:
    """NULL outside the valid range; values are never clamped."""
    ok = c.isNotNull()
    if lo is not None:
        ok = ok & (c >= F.lit(lo))
    if hi is not None:
        ok = ok & (c <= F.lit(hi))
    return F.when(ok, c)


def normalised_difference(a: Column, b: Column, guard: float = 0.0) -> Column:
    """(a - b) / (a + b + guard)."""
    return ratio(a - b, a + b + F.lit(guard) if guard else a + b)
