"""Published relations (L1, L3, L10-L16) as functions of DataFrames and ``as_of``.

Every "LATERAL ... ORDER BY t DESC LIMIT 1" becomes ``latest_per_key`` (an
aggregate with map-side combine) followed by a left join to the station
dimension; every per-key window runs on a time-bounded slice.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..config import POLLUTANTS, SIMPLE_FORECAST_HOURS, SIMPLE_FORECAST_LAG_ROW
from ..functions import aqi_category, hours_between
from ..operators import latest_per_key, top_k_per_key
from ..operators.dimension import attach
from .common import until, window

AQ_VALUES = ["aqi", *POLLUTANTS]


def station_latest_air_quality(aq: DataFrame, wx: DataFrame, stations: DataFrame, as_of: datetime) -> DataFrame:
    """L1: latest AQ row and latest weather row per active station, coalesced; weather columns of the
    AQ fact come first where it has them."""
    weather = ["temperature_c", "humidity_pct", "wind_speed_mps"]
    carried = [c for c in weather if c in aq.columns]
    a = latest_per_key(until(aq, as_of), ["station_id"], ["observed_at", "obs_id"],
                       ["observed_at", "fetched_at", *AQ_VALUES, *carried, "provider_code", "endpoint_code"])
    w = latest_per_key(until(wx, as_of), ["station_id"], ["observed_at", "obs_id"],
                       ["fetched_at", *weather])
    w = w.select("station_id", *[F.col(c).alias(f"w_{c}") for c in w.columns if c != "station_id"])
    s = stations.filter("is_active").select("station_id", F.col("code").alias("station_code"), "lat", "lng", "is_active")
    j = s.join(a, "station_id", "left").join(w, "station_id", "left")
    return j.select(
        "station_id", "station_code", "lat", "lng", "is_active", "observed_at",
        F.coalesce("fetched_at", "w_fetched_at").alias("fetched_at"),
        *AQ_VALUES,
        *[F.coalesce(*[F.col(c)] * (c in carried), F.col(f"w_{c}")).alias(c) for c in weather],
        F.col("provider_code").alias("source_provider_code"),
        F.col("endpoint_code").alias("source_endpoint_code"),
    )


def station_source_latest(aq: DataFrame, stations: DataFrame, as_of: datetime) -> DataFrame:
    """L3: latest AQ row per station (all stations) with its lineage ids."""
    a = latest_per_key(until(aq, as_of), ["station_id"], ["observed_at", "obs_id"],
                       ["observed_at", "fetched_at", "aqi", "provider_code", "endpoint_code",
                        "pipeline_run_id", "raw_payload_id", "normalize_run_id"])
    s = stations.select("station_id", F.col("code").alias("station_code"))
    return s.join(a, "station_id", "left").select(
        "station_id", "station_code", "observed_at", "fetched_at", "aqi",
        F.col("provider_code").alias("source_provider_code"), F.col("endpoint_code").alias("source_endpoint_code"),
        "pipeline_run_id", "raw_payload_id", "normalize_run_id",
    )


def station_24h_summary(aq: DataFrame, stations: DataFrame, as_of: datetime) -> DataFrame:
    """24 h stats per active station; stations without rows keep samples = 0."""
    recent = window(aq, as_of, hours=24, inclusive_start=True)
    g = recent.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("samples"),
        round_half_up(F.avg("aqi"), 2).alias("aqi_avg"),
        F.min("aqi").alias("aqi_min"),
        F.max("aqi").alias("aqi_max"),
        *[round_half_up(F.avg(p), 2).alias(f"{p}_avg") for p in POLLUTANTS],
        F.max("observed_at").alias("last_observed_at"),
    )
    s = stations.filter("is_active").select("station_id", F.col("code").alias("station_code"))
    j = s.join(g, "station_id", "left")
    return j.withColumn("samples", F.coalesce(F.col("samples"), F.lit(0)))


def simple_forecast(aq: DataFrame, as_of: datetime) -> DataFrame:
    """Slope between the newest and the 6th-newest row of the last 12 h, projected 1/3/6 h."""
    recent = window(aq, as_of, hours=SIMPLE_FORECAST_HOURS, inclusive_start=True).select("station_id", "observed_at", "obs_id", "aqi")
    top = top_k_per_key(recent, ["station_id"], [F.col("observed_at").desc(), F.col("obs_id").desc()], SIMPLE_FORECAST_LAG_ROW)
    g = top.groupBy("station_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("aqi"))).alias("last_aqi"),
        F.max(F.when(F.col("rn") == 1, F.col("observed_at"))).alias("last_at"),
        F.max(F.when(F.col("rn") == SIMPLE_FORECAST_LAG_ROW, F.col("aqi"))).alias("aqi6"),
        F.max(F.when(F.col("rn") == SIMPLE_FORECAST_LAG_ROW, F.col("observed_at"))).alias("t6"),
    )
    hrs = hours_between(F.col("last_at"), F.col("t6"))
    slope = round_half_up(F.coalesce(F.try_divide((F.col("last_aqi") - F.col("aqi6")).cast("double"), F.nullif(hrs, F.lit(0.0))), F.lit(0.0)), 3)
    g = g.withColumn("aqi_per_hour", slope)
    proj = lambda h: F.greatest(F.lit(0.0), round_half_up(F.col("last_aqi") + F.col("aqi_per_hour") * h)).cast("int")
    return g.select("station_id", "last_at", "last_aqi", "aqi_per_hour",
                    proj(1).alias("aqi_next_1h"), proj(3).alias("aqi_next_3h"), proj(6).alias("aqi_next_6h"))


def station_analytics(aq: DataFrame, wx: DataFrame, stations: DataFrame, as_of: datetime) -> DataFrame:
    """L1 + L11 + L12 with categories."""
    v = station_latest_air_quality(aq, wx, stations, as_of)
    s24 = station_24h_summary(aq, stations, as_of).select(
        "station_id", F.col("samples").alias("samples_24h"), "aqi_avg", "aqi_min", "aqi_max", "pm25_avg", "pm10_avg")
    f = simple_forecast(aq, as_of).select("station_id", "aqi_next_1h", "aqi_next_3h", "aqi_next_6h",
                                          F.col("aqi_per_hour").alias("forecast_slope_per_hour"))
    j = v.join(s24, "station_id", "left").join(f, "station_id", "left")
    return j.select(
        "station_id", "station_code", "lat", "lng", F.col("aqi").alias("current_aqi"),
        aqi_category(F.col("aqi")).alias("current_category"), *POLLUTANTS,
        "temperature_c", "humidity_pct", "wind_speed_mps", "observed_at",
        "samples_24h", "aqi_avg", "aqi_min", "aqi_max", "pm25_avg", "pm10_avg",
        aqi_category(F.col("aqi_avg")).alias("avg_category_24h"),
        "aqi_next_1h", "aqi_next_3h", "aqi_next_6h", "forecast_slope_per_hour",
        aqi_category(F.col("aqi_next_6h")).alias("forecast_category_6h"),
    )


def provider_rank(provider: F.Column) -> F.Column:
    """E2 priority: station network (waqi) before model data."""
    return F.when(provider == "waqi", F.lit(1)).otherwise(F.lit(2))


def fused_observations(aq: DataFrame) -> DataFrame:
    """One row per (station, hour): best provider, then newest fetch (NULLS LAST)."""
    h = aq.withColumn("hour", F.date_trunc("hour", "observed_at"))
    order = [-provider_rank(F.col("provider_code")), F.col("fetched_at"), F.col("obs_id")]
    return latest_per_key(h, ["station_id", "hour"], order,
                          ["obs_id", "observed_at", *AQ_VALUES, "provider_code", "fetched_at"])


def source_compare(aq: DataFrame, stations: DataFrame) -> DataFrame:
    """Per observation: station, hour bucket, provider and values."""
    s = stations.select("station_id", F.col("code").alias("station_code"))
    return attach(aq, s, "station_id", "inner").select(
        "station_id", "station_code", F.date_trunc("hour", "observed_at").alias("hour"), "provider_code",
        "obs_id", *AQ_VALUES, "fetched_at",
    )


def generate_bindings(stations: DataFrame, existing: DataFrame, as_of: datetime,
                      provider: str = "waqi", endpoint: str = "waqi_station", priority: int = 200) -> DataFrame:
    """L16 + N3: one binding per active station for ``endpoint``, skipping (station, endpoint)
    pairs that already exist (insert-ignore as a left anti join)."""
    from ..sources.binding import ts_lit

    new = stations.filter("is_active").select(
        "station_id", F.lit(provider).alias("provider_code"), F.lit(endpoint).alias("endpoint_code"),
        F.lit(True).alias("is_enabled"), F.lit(priority).alias("priority"), ts_lit(as_of).alias("valid_from"),
    )
    return new.join(existing.select("station_id", "endpoint_code"), ["station_id", "endpoint_code"], "left_anti")
