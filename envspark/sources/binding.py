"""Binding of the driver's tables to the observation data model.

``events(event_id, ts, user_id, event_type, value, props)`` is the only fact the
driver provides.  It becomes air-quality observations (click/error/purchase),
weather observations (view/signup) and a station dimension, arithmetically, so
that the same binding can be written in SQL for the oracle.  Timestamps stay
``TIMESTAMP_NTZ`` wall-clock UTC, so a time-window predicate on ``observed_at``
is a predicate on the raw ``ts`` column and reaches the Parquet scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

N_STATIONS = 12  # station_id = user_id % 12; the station dimension is bounded by construction
AS_OF = datetime(2024, 1, 31, 0, 0, 0)

AQ_EVENT_TYPES = ["click", "error", "purchase"]
WX_EVENT_TYPES = ["view", "signup"]


def ts_lit(value: datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal (wall-clock UTC)."""
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S")
    return F.to_timestamp_ntz(F.lit(text))


def obs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    return ev.select(
        F.col("event_id").alias("obs_id"),
        (F.col("user_id") % N_STATIONS).cast("int").alias("station_id"),
        F.col("ts").alias("observed_at"),
        "event_type",
        "value",
        F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)").alias("k"),
    )


def lineage_columns(provider: Column) -> list[Column]:
    """Ingest lineage derived from each row: fetched_at lags observed_at by up to 10 min;
    one pipeline run per provider-hour; one raw payload per run and station."""
    hour = F.date_format(F.date_trunc("hour", F.col("observed_at")), "yyyyMMddHH")
    run = F.concat(provider, F.lit("-"), hour)
    return [
        F.expr("timestampadd(SECOND, obs_id % 600, observed_at)").alias("fetched_at"),
        F.concat(provider, F.lit("_hourly")).alias("endpoint_code"),
        run.alias("pipeline_run_id"),
        F.concat(run, F.lit("-"), F.col("station_id").cast("string")).alias("raw_payload_id"),
        F.concat(run, F.lit("-n")).alias("normalize_run_id"),
    ]


def aq_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Air-quality observations: obs_id, station_id, observed_at, provider_code, aqi, pm25..co."""
    b = obs_base(spark, sf_dir).filter(F.col("event_type").isin(AQ_EVENT_TYPES))
    oid, v, k = F.col("obs_id"), F.col("value"), F.col("k")
    return b.select(
        "obs_id", "station_id", "observed_at",
        F.when(F.col("event_type") == "click", "waqi").otherwise("openmeteo").alias("provider_code"),
        F.floor(v).cast("int").alias("aqi"),
        (v * 0.4 + k * 0.1).alias("pm25"),
        (v * 0.8 + k * 0.2).alias("pm10"),
        F.when(oid % 7 == 0, F.lit(None).cast("double")).otherwise(k).alias("o3"),
        F.when(oid % 5 == 0, F.lit(None).cast("double")).otherwise(F.lit(100.0) - k + v * 0.05).alias("no2"),
        (oid % 23).cast("double").alias("so2"),
        F.lit(3.5).cast("double").alias("co"),
        *lineage_columns(F.when(F.col("event_type") == "click", "waqi").otherwise("openmeteo")),
    )


def wx_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather observations: obs_id, station_id, observed_at, temperature_c, humidity_pct, ..."""
    b = obs_base(spark, sf_dir).filter(F.col("event_type").isin(WX_EVENT_TYPES))
    oid, v, k = F.col("obs_id"), F.col("value"), F.col("k")
    return b.select(
        "obs_id", "station_id", "observed_at",
        (F.lit(20.0) + k * 0.1).alias("temperature_c"),
        (oid % 101).cast("double").alias("humidity_pct"),
        (v * 0.02).alias("wind_speed_mps"),
        (F.lit(1000) + oid % 30).cast("double").alias("pressure_hpa"),
        F.when(oid % 3 != 0, F.lit(None).cast("double")).otherwise(k * 0.1).alias("precipitation_mm"),
        ((oid * 7) % 101).cast("double").alias("cloud_cover_pct"),
        F.expr("timestampadd(SECOND, obs_id % 900, observed_at)").alias("fetched_at"),
    )


def station_columns(station_id: Column) -> list[Column]:
    sid = station_id
    return [
        F.concat(F.lit("ST-"), sid.cast("string")).alias("code"),
        (F.lit(9.05) + F.lit(1.2) * sid.cast("double")).alias("lat"),
        (F.lit(103.03) + F.lit(0.55) * ((sid * 5) % 12).cast("double")).alias("lng"),
        (sid != 11).alias("is_active"),
    ]


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension: distinct stations seen in events (partial aggregation, <= 12 rows).

    In a deployment this is its own small table.  Derived here, it would cost a scan of the
    whole ``user_id`` column per job, so the 12-row result is cached: Spark's cache manager
    matches the identical plan of every later job in the session and serves it from memory."""
    ids = read_table(spark, sf_dir, "events", ["user_id"]).select(
        (F.col("user_id") % N_STATIONS).cast("int").alias("station_id")
    ).distinct()
    return ids.select("station_id", *station_columns(F.col("station_id"))).persist()


class Bound:
    """Lazily built DataFrames of one binding (one sf_dir)."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: datetime = AS_OF):
        from ..session import pin_utc

        pin_utc(spark)
        self.spark, self.sf_dir, self.as_of = spark, sf_dir, as_of
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name, fn):
        if name not in self._cache:
            self._cache[name] = fn(self.spark, self.sf_dir)
        return self._cache[name]

    @property
    def aq(self) -> DataFrame:
        return self._get("aq", aq_observations)

    @property
    def wx(self) -> DataFrame:
        return self._get("wx", wx_observations)

    @property
    def stations(self) -> DataFrame:
        return self._get("stations", stations)
