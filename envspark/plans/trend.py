"""I5 — 30-day trend per (station, metric): daily means (2 dp) -> OLS on the
ordinal index of the non-null days (E7) -> slope, intercept, R^2, % change,
direction, first-3 / last-3 / overall means.

Only the daily aggregate (<= 30 rows per key) is windowed; the regression is the
built-in ``regr_*`` family, one grouped aggregate for all keys.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import METRICS, TREND_DAYS, TREND_MIN_DAYS
from ..functions import trend_direction
from ..functions.numeric import mean_half_even, round_half_up
from .common import active_only, window


def trend_analysis(aq: DataFrame, stations: DataFrame, as_of: datetime) -> DataFrame:
    base = active_only(window(aq, as_of, days=TREND_DAYS), stations)
    daily = base.groupBy("station_id", F.to_date("observed_at").alias("day")).agg(
        *[round_half_up(F.avg(m), 2).alias(m) for m in METRICS]
    )
    n_days = F.count(F.lit(1)).over(Window.partitionBy("station_id"))
    daily = daily.withColumn("_nd", n_days).filter(F.col("_nd") >= TREND_MIN_DAYS).drop("_nd")
    long = daily.unpivot(["station_id", "day"], METRICS, "metric", "y").filter(F.col("y").isNotNull())
    w = Window.partitionBy("station_id", "metric").orderBy("day")
    long = (
        long.withColumn("x", (F.row_number().over(w) - 1).cast("double"))
        .withColumn("_rd", F.row_number().over(Window.partitionBy("station_id", "metric").orderBy(F.col("day").desc())))
    )
    g = long.groupBy("station_id", "metric").agg(
        F.count(F.lit(1)).alias("data_points"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("_r2"),
        (F.min("y") < F.max("y")).alias("_vy"),  # exact: not a constant series
        mean_half_even(F.when(F.col("x") < 3, F.col("y")), 2).alias("start_avg"),
        mean_half_even(F.when(F.col("_rd") <= 3, F.col("y")), 2).alias("end_avg"),
        mean_half_even(F.col("y"), 2).alias("overall_avg"),
    ).filter(F.col("data_points") >= TREND_MIN_DAYS)
    start = F.col("intercept")
    end = F.col("slope") * (F.col("data_points") - 1) + F.col("intercept")
    pct = F.when(start != 0, (end - start) / start * 100).otherwise(F.lit(0.0))
    r2 = F.when(F.col("_vy"), F.col("_r2")).otherwise(F.lit(0.0))  # constant series -> 0 (trap T10)
    out = g.select(
        "station_id", "metric",
        F.bround("slope", 4).alias("slope"),
        F.bround("intercept", 2).alias("intercept"),
        F.bround(r2, 4).alias("r_squared"),
        F.bround(pct, 2).alias("pct_change"),
        trend_direction(pct).alias("direction"),
        "start_avg", "end_avg", "overall_avg",
        "data_points",
    )
    overall = out.groupBy("station_id").agg(
        F.coalesce(F.max(F.when(F.col("metric") == "aqi", F.col("direction"))), F.lit("unknown")).alias("overall_direction")
    )
    return out.join(overall, "station_id")
