"""I6 — health impact over the last 48 h per active station (>= 6 AQI rows):
current / average / max AQI, levels, risk, advice, exposure score, dominant
pollutant, time in levels and pollutant averages — one grouped aggregate
(``max_by`` for the current row, conditional sums for the histogram)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AQI_LEVELS, EXPOSURE_MAX_WEIGHT, HEALTH_HOURS, HEALTH_MIN_ROWS, POLLUTANTS
from ..functions import aqi_level_field, exposure_weight
from ..functions.aqi import in_level_band
from ..functions.numeric import mean_half_even, ratio_half_even
from .common import active_only, window


def dominant_pollutant(avgs: dict[str, "F.Column"]) -> "F.Column":
    """Pollutant with the highest average; ties -> first in POLLUTANTS; none -> 'pm25'."""
    top = F.greatest(*avgs.values())
    expr = F.when(top.isNull(), F.lit("pm25"))
    for name, c in avgs.items():
        expr = expr.when(c == top, F.lit(name))
    return expr.otherwise(F.lit("pm25"))


def health_impact(aq: DataFrame, stations: DataFrame, as_of: datetime, strict: bool = False) -> DataFrame:
    base = active_only(window(aq, as_of, hours=HEALTH_HOURS), stations).filter(F.col("aqi").isNotNull())
    v = F.col("aqi").cast("double")
    g = base.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.max_by(v, F.struct(F.col("observed_at"), F.col("obs_id"))).alias("current"),
        F.avg(v).alias("avg"),
        mean_half_even(v, 2, scale_in=0).alias("_avg2"),
        F.max(v).alias("max"),
        F.sum(exposure_weight(v)).alias("_w"),
        *[F.avg(p).alias(f"{p}_avg") for p in POLLUTANTS],
        *[F.sum(F.when(in_level_band(v, i), 1).otherwise(0)).alias(f"_lvl{i}") for i in range(len(AQI_LEVELS))],
    ).filter(F.col("samples") >= HEALTH_MIN_ROWS)
    cur, avg = F.col("current"), F.col("avg")
    til = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(AQI_LEVELS[i][2]).alias("k"), F.col(f"_lvl{i}").cast("long").alias("v"))
                  for i in range(len(AQI_LEVELS))]),
        lambda e: e["v"] > 0,
    ))
    pav = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(p).alias("k"), F.col(f"{p}_avg").alias("v")) for p in POLLUTANTS]),
        lambda e: e["v"].isNotNull(),
    ))
    return g.select(
        "station_id",
        F.lit(HEALTH_HOURS).alias("period_hours"),
        "samples",
        F.bround(cur, 2).alias("current_aqi"),
        F.col("_avg2").alias("avg_aqi"),
        F.bround(F.col("max"), 2).alias("max_aqi"),
        aqi_level_field(cur, "label", strict).alias("current_level"),
        aqi_level_field(avg, "label", strict).alias("avg_level"),
        aqi_level_field(cur, "risk", strict).alias("risk_level"),
        (ratio_half_even(F.col("_w").cast("long") * 1000, F.col("samples") * EXPOSURE_MAX_WEIGHT) / 10).alias("exposure_score"),
        dominant_pollutant({p: F.col(f"{p}_avg") for p in POLLUTANTS}).alias("dominant_pollutant"),
        til.alias("time_in_levels"),
        pav.alias("pollutant_averages"),
        aqi_level_field(cur, "advice_vi", strict).alias("advice_vi"),
        aqi_level_field(cur, "advice_en", strict).alias("advice_en"),
    )
