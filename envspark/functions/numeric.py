"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(x: Column, digits: int = 0) -> Column:
    """Python ``round`` (half-even); SQL NUMERIC casts use ``F.round`` (half-up)."""
    return F.bround(x, digits)


def confidence_from_mae(mae: Column) -> Column:
    """H8: round(clamp(1 - mae/100, 0.3, 0.95), 2); NULL -> 0.5."""
    raw = F.greatest(F.lit(0.3), F.least(F.lit(0.95), F.lit(1.0) - mae / 100.0))
    return F.when(mae.isNull(), F.lit(0.5)).otherwise(F.bround(raw, 2))


def ratio_half_even(num: Column, den: Column) -> Column:
    """Integer ``num / den`` rounded half-to-even, exactly (no floating point)."""
    r = F.pmod(num, den)
    q = (num - r).cast("long") / den
    q = q.cast("long")
    twice = r * 2
    return (
        F.when(twice > den, q + 1)
        .when(twice == den, q + F.pmod(q, F.lit(2)))
        .otherwise(q)
    )


def mean_half_even(x: Column, digits: int, scale_in: int | None = None) -> Column:
    """Aggregate: mean of ``x`` (values with at most ``scale_in`` decimals, default
    ``digits``) rounded half-even to ``digits`` places, computed on exact integers so
    that ties (x.xx5) round the same way in every engine."""
    s_in = digits if scale_in is None else scale_in
    units = F.round(x * (10 ** s_in)).cast("long")
    num = F.sum(units) * (10 ** digits)
    den = F.count(units) * (10 ** s_in)
    return ratio_half_even(num, den) / (10 ** digits)


TIE_NUDGE = 1e-9


def round_half_up(x, digits: int = 0) -> Column:
    """SQL ``ROUND`` / ``NUMERIC(p,s)`` cast: half away from zero on the *decimal* value.

    A mean of decimals that lands exactly on a tie (70.195) is stored as a double a
    hair above or below it depending on summation order; the signed 1e-9 nudge makes
    such ties round away from zero whatever the engine or order.  Values in this
    domain carry <= 4 decimals, so no non-tie value is within 1e-9 of a boundary."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c + F.signum(c) * F.lit(TIE_NUDGE), digits)
