"""AQI-related column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    AQI_CATEGORY_ABOVE, AQI_CATEGORY_NULL, AQI_CATEGORY_THRESHOLDS, AQI_LEVELS, EXPOSURE_MAX_WEIGHT,
    FRESH_HOURS, PM25_BREAKPOINTS, STALE_HOURS, TREND_STABLE_PCT,
)

_LEVEL_FIELDS = {"label": 2, "risk": 3, "weight": 4, "advice_vi": 5, "advice_en": 6}


def aqi_category(x: Column) -> Column:
    """H1: category from inclusive upper thresholds; NULL -> 'unknown'."""
    expr = F.when(x.isNull(), F.lit(AQI_CATEGORY_NULL))
    for upper, label in AQI_CATEGORY_THRESHOLDS:
        expr = expr.when(x <= upper, F.lit(label))
    return expr.otherwise(F.lit(AQI_CATEGORY_ABOVE))


def aqi_level_field(x: Column, field: str, strict: bool = False) -> Column:
    """H2: a field of the AQI level of ``x``.

    strict=False: thresholds (``x <= max`` of the first band) so fractional values
    between integer bands fall in the lower band.  strict=True: closed integer
    bands ``min <= x <= max`` with no match -> the last band (a gap value such as
    50.5 becomes 'hazardous', as the replaced service does).
    """
    idx = _LEVEL_FIELDS[field]
    last = AQI_LEVELS[-1][idx]
    expr = None
    for band in AQI_LEVELS:
        lo, hi, val = band[0], band[1], band[idx]
        cond = (x >= lo) & (x <= hi) if strict else (x <= hi)
        expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    return expr.otherwise(F.lit(last))


def aqi_level(x: Column, strict: bool = False) -> Column:
    return aqi_level_field(x, "label", strict)


def exposure_weight(x: Column) -> Column:
    """H3: weight of the first band whose max >= x; above all bands -> 16."""
    expr = None
    for band in AQI_LEVELS:
        hi, w = band[1], band[4]
        expr = F.when(x <= hi, F.lit(w)) if expr is None else expr.when(x <= hi, F.lit(w))
    return expr.otherwise(F.lit(EXPOSURE_MAX_WEIGHT))


def in_level_band(x: Column, band_index: int) -> Column:
    lo, hi = AQI_LEVELS[band_index][0], AQI_LEVELS[band_index][1]
    return (x >= lo) & (x <= hi)


def pm25_to_aqi(pm25: Column, strict: bool = False) -> Column:
    """H4: EPA PM2.5 -> US AQI, piecewise linear, half-even rounding.

    NULL/NaN/negative -> NULL; above 500.4 -> 500.  strict=True leaves the
    breakpoint gaps (12.05) NULL; the default first truncates to 0.1 ug/m3 as the
    EPA procedure prescribes, which closes the gaps.
    """
    c = pm25 if strict else F.floor(pm25 * 10) / 10
    bad = pm25.isNull() | F.isnan(pm25) | (pm25 < 0)
    expr = F.when(bad, F.lit(None).cast("int"))
    for c_lo, c_hi, i_lo, i_hi in PM25_BREAKPOINTS:
        val = F.lit((i_hi - i_lo) / (c_hi - c_lo)) * (c - F.lit(c_lo)) + F.lit(i_lo)
        expr = expr.when((c >= c_lo) & (c <= c_hi), F.bround(val, 0).cast("int"))
    return expr.when(pm25 > 500.4, F.lit(500)).otherwise(F.lit(None).cast("int"))


def freshness_status(age_hours: Column) -> Column:
    """no_data / fresh (<6 h) / stale (<24 h) / expired."""
    return (
        F.when(age_hours.isNull(), F.lit("no_data"))
        .when(age_hours < FRESH_HOURS, F.lit("fresh"))
        .when(age_hours < STALE_HOURS, F.lit("stale"))
        .otherwise(F.lit("expired"))
    )


def trend_direction(pct: Column) -> Column:
    """|pct| < 5 stable, > 0 worsening, else improving."""
    return (
        F.when(F.abs(pct) < TREND_STABLE_PCT, F.lit("stable"))
        .when(pct > 0, F.lit("worsening"))
        .otherwise(F.lit("improving"))
    )


def anomaly_severity(z: Column, iqr_f: Column) -> Column:
    """Critical if |z|>=4 or f>=3; warning if |z|>=3 or f>=1.5; else info."""
    return (
        F.when((F.abs(z) >= 4.0) | (iqr_f >= 3.0), F.lit("critical"))
        .when((F.abs(z) >= 3.0) | (iqr_f >= 1.5), F.lit("warning"))
        .otherwise(F.lit("info"))
    )
