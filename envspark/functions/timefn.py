"""Time column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_sin(ts: Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * F.hour(ts) / 24)


def hour_cos(ts: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * F.hour(ts) / 24)


def dow_mon0(ts: Column) -> Column:
    """Day of week with Monday = 0 (pandas ``dayofweek``)."""
    return F.weekday(ts)


def dow_sun0(ts: Column) -> Column:
    """Day of week with Sunday = 0 (SQL ``EXTRACT(DOW)``)."""
    return F.dayofweek(ts) - 1


def dow_sin(ts: Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * dow_mon0(ts) / 7)


def dow_cos(ts: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * dow_mon0(ts) / 7)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since epoch of a wall-clock UTC timestamp (NTZ or LTZ)."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def hours_between(later: Column, earlier: Column) -> Column:
    """EXTRACT(EPOCH FROM later - earlier) / 3600 as a double."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9
