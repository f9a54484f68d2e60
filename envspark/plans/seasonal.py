"""I3 — seasonal pattern of one metric over 30 days: hourly and day-of-week
profiles, peak / off-peak hours, best / worst weekday, overall level.

Both profiles come from one GROUPING SETS aggregate keyed by (station, hour) and
(station, dow): at most 24 and 7 rows per station, so the ranking windows that
follow run on bounded groups.
"""

from __future__ import annotations

from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import METRICS, SEASONAL_DAYS, SEASONAL_MIN_HOURS
from ..functions import dow_sun0
from ..functions.numeric import mean_half_even, round_half_up
from .common import active_only, window


def _metric(metric: str) -> str:
    return metric if metric in METRICS else "aqi"  # B2 allow-list


def _base(aq, stations, as_of, metric):
    m = _metric(metric)
    df = active_only(window(aq, as_of, days=SEASONAL_DAYS), stations)
    return df.filter(F.col(m).isNotNull()).select("station_id", "observed_at", F.col(m).cast("double").alias("v")), m


def _profiles(aq: DataFrame, stations: DataFrame, as_of: datetime, metric: str) -> tuple[DataFrame, DataFrame]:
    """Hourly and day-of-week profiles from ONE scan and ONE shuffle (GROUPING SETS
    (station, hour), (station, dow)); the >= 12-hour gate applies to both."""
    base, m = _base(aq, stations, as_of, metric)
    base = base.withColumn("hour", F.hour("observed_at")).withColumn("dow", dow_sun0(F.col("observed_at")))
    g = base.groupingSets([["station_id", "hour"], ["station_id", "dow"]], "station_id", "hour", "dow").agg(
        round_half_up(F.avg("v"), 2).alias("avg_val"),
        round_half_up(F.stddev_samp("v"), 2).alias("std_val"),
        round_half_up(F.min("v"), 2).alias("min_val"),
        round_half_up(F.max("v"), 2).alias("max_val"),
        F.count(F.lit(1)).alias("samples"),
    )
    # <= 31 rows per station, read by three branches: materialise once instead of rescanning
    g = g.persist(StorageLevel.MEMORY_AND_DISK)
    hp = g.filter(F.col("dow").isNull()).select("station_id", "hour", "avg_val", "std_val", "min_val", "max_val", "samples")
    n_hours = F.count(F.lit(1)).over(Window.partitionBy("station_id"))  # <= 24 rows per station
    hp = hp.withColumn("_nh", n_hours).filter(F.col("_nh") >= SEASONAL_MIN_HOURS).drop("_nh").withColumn("metric", F.lit(m))
    dp = g.filter(F.col("hour").isNull()).select("station_id", "dow", "avg_val", "std_val", "samples")
    dp = dp.join(hp.select("station_id").distinct(), "station_id", "left_semi").withColumn("metric", F.lit(m))
    return hp, dp


def hourly_profile(aq: DataFrame, stations: DataFrame, as_of: datetime, metric: str = "aqi") -> DataFrame:
    return _profiles(aq, stations, as_of, metric)[0]


def dow_profile(aq: DataFrame, stations: DataFrame, as_of: datetime, metric: str = "aqi") -> DataFrame:
    return _profiles(aq, stations, as_of, metric)[1]


def seasonal_summary(aq: DataFrame, stations: DataFrame, as_of: datetime, metric: str = "aqi") -> DataFrame:
    """Rows: station_id, metric, peak_hours, off_peak_hours (arrays), best_dow, worst_dow,
    overall_avg, hourly_variation, hourly_profile, daily_profile (arrays of structs)."""
    hp, dp = _profiles(aq, stations, as_of, metric)
    # Stable sort by avg desc keeps ascending hour order among ties
    desc_rank = F.row_number().over(Window.partitionBy("station_id").orderBy(F.col("avg_val").desc(), F.col("hour").asc()))
    n = F.count(F.lit(1)).over(Window.partitionBy("station_id"))
    hp = hp.withColumn("_r", desc_rank).withColumn("_n", n)
    h = hp.groupBy("station_id", "metric").agg(
        F.array_sort(F.collect_list(F.when(F.col("_r") <= 3, F.struct("_r", "hour")))).alias("_peak"),
        F.array_sort(F.collect_list(F.when(F.col("_r") > F.col("_n") - 3, F.struct("_r", "hour")))).alias("_off"),
        mean_half_even(F.col("avg_val"), 2).alias("overall_avg"),
        F.bround(F.stddev_pop("avg_val"), 2).alias("hourly_variation"),
        F.array_sort(F.collect_list(F.struct(
            "hour", F.col("avg_val").alias("avg"), F.col("std_val").alias("std"), F.col("min_val").alias("min"),
            F.col("max_val").alias("max"), "samples"))).alias("hourly_profile"),
    )
    # best = lowest avg (ties -> lowest dow); worst = highest avg (ties -> highest dow)
    d = dp.groupBy("station_id").agg(
        F.min_by("dow", F.struct(F.col("avg_val"), F.col("dow"))).alias("best_dow"),
        F.max_by("dow", F.struct(F.col("avg_val"), F.col("dow"))).alias("worst_dow"),
        F.array_sort(F.collect_list(F.struct(
            "dow", F.col("avg_val").alias("avg"), F.col("std_val").alias("std"), "samples"))).alias("daily_profile"),
    )
    out = h.join(d, "station_id", "left")
    return out.select(
        "station_id", "metric",
        F.transform("_peak", lambda s: s["hour"]).alias("peak_hours"),
        F.transform("_off", lambda s: s["hour"]).alias("off_peak_hours"),
        "best_dow", "worst_dow", "overall_avg", "hourly_variation", "hourly_profile", "daily_profile",
    )
