"""Shared plan pieces: time windows, active-station filter, wide -> long."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import METRICS
from ..operators.dimension import attach
from ..sources.binding import ts_lit


def window(df: DataFrame, as_of: datetime, *, days: float = 0, hours: float = 0, inclusive_start: bool = False) -> DataFrame:
    """Rows with ``as_of - span < observed_at <= as_of`` (predicate on the raw time column)."""
    start = as_of - timedelta(days=days, hours=hours)
    lo = F.col("observed_at") >= ts_lit(start) if inclusive_start else F.col("observed_at") > ts_lit(start)
    return df.filter(lo & (F.col("observed_at") <= ts_lit(as_of)))


def until(df: DataFrame, as_of: datetime) -> DataFrame:
    """Rows observed at or before ``as_of``."""
    return df.filter(F.col("observed_at") <= ts_lit(as_of))


def active_only(df: DataFrame, stations: DataFrame) -> DataFrame:
    return attach(df, stations.filter("is_active").select("station_id"), "station_id", "left_semi")


def to_long(df: DataFrame, ids: list[str], metrics: list[str] = METRICS, drop_null: bool = True) -> DataFrame:
    """Wide metric columns -> (ids..., metric, value) with value as double."""
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = wide.unpivot(ids, metrics, "metric", "value")
    return long.filter(F.col("value").isNotNull()) if drop_null else long
