"""I1 — daily summary per active station and day.

The replaced job joins air-quality rows to weather rows of the same station-day
before aggregating, which multiplies rows (n_aq x n_wx).  Here each side is
aggregated first (partial + final aggregation, one shuffle each on
(station_id, day)) and the two small results are joined 1:1 — no fan-out.
``strict=True`` reproduces the fan-out's visible effects arithmetically
(samples x max(w,1), shrunken sample std, 0 -> NULL) without building it.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..config import POLLUTANTS
from ..functions import aqi_category


def daily_summary(
    aq: DataFrame,
    wx: DataFrame,
    stations: DataFrame,
    start: date | None = None,
    end: date | None = None,
    strict: bool = False,
) -> DataFrame:
    """Rows: station_id, summary_date, samples, aqi_avg/min/max/stddev, <pollutant>_avg,
    temp_avg, humidity_avg, wind_avg, category.  Days in [start, end] (inclusive) when given."""

    def day_filter(df):
        d = F.to_date("observed_at")
        if start is not None:
            df = df.filter(F.col("observed_at") >= F.to_timestamp_ntz(F.lit(f"{start} 00:00:00")))
        if end is not None:
            df = df.filter(F.col("observed_at") < F.to_timestamp_ntz(F.lit(f"{end} 00:00:00")) + F.expr("INTERVAL 1 DAY"))
        return df.withColumn("summary_date", d)

    aq_day = (
        day_filter(aq)
        .groupBy("station_id", "summary_date")
        .agg(
            F.count(F.lit(1)).alias("n_aq"),
            F.avg("aqi").alias("aqi_avg"),
            F.min("aqi").alias("aqi_min"),
            F.max("aqi").alias("aqi_max"),
            F.stddev_samp("aqi").alias("aqi_sd"),
            F.count("aqi").alias("n_aqi"),
            *[F.avg(p).alias(f"{p}_avg") for p in POLLUTANTS],
        )
    )
    wx_day = (
        day_filter(wx)
        .groupBy("station_id", "summary_date")
        .agg(
            F.count(F.lit(1)).alias("n_wx"),
            F.avg("temperature_c").alias("temp_avg"),
            F.avg("humidity_pct").alias("humidity_avg"),
            F.avg("wind_speed_mps").alias("wind_avg"),
        )
    )
    active = stations.filter("is_active").select("station_id")
    j = aq_day.join(active, "station_id", "left_semi").join(wx_day, ["station_id", "summary_date"], "left")

    w = F.greatest(F.coalesce(F.col("n_wx"), F.lit(0)), F.lit(1))
    if strict:
        # fan-out: every aq row repeated w times -> SS scales by w, n by w
        n = F.col("n_aqi")
        ss = F.col("aqi_sd") * F.col("aqi_sd") * (n - 1)
        sd = F.when(n * w > 1, F.sqrt(ss * w / (n * w - 1)))
        samples = F.col("n_aq") * w
    else:
        sd = F.col("aqi_sd")
        samples = F.col("n_aq")

    def num(c, s=2):
        r = round_half_up(c, s)
        return F.nullif(r, F.lit(0.0)) if strict else r

    out = j.select(
        "station_id",
        "summary_date",
        samples.cast("long").alias("samples"),
        num(F.col("aqi_avg")).alias("aqi_avg"),
        num(F.col("aqi_min").cast("double")).alias("aqi_min"),
        num(F.col("aqi_max").cast("double")).alias("aqi_max"),
        num(sd).alias("aqi_stddev"),
        *[num(F.col(f"{p}_avg")).alias(f"{p}_avg") for p in POLLUTANTS],
        num(F.col("temp_avg")).alias("temp_avg"),
        num(F.col("humidity_avg")).alias("humidity_avg"),
        num(F.col("wind_avg")).alias("wind_avg"),
        aqi_category(round_half_up(F.col("aqi_avg"), 2)).alias("category"),
    )
    return out


def summary_of_day(aq: DataFrame, wx: DataFrame, stations: DataFrame, as_of: datetime, day: date | None = None, strict: bool = False) -> DataFrame:
    """Summaries of one day, by default the one before ``as_of``; only its rows are read."""
    day = day or as_of.date() - timedelta(days=1)
    return daily_summary(aq, wx, stations, day, day, strict)
