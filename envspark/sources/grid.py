"""Grid dimension (A11) and grid observations derived from the driver's events.

The lattice is 77 x 41 = 3,157 points by construction (a proven size bound, so
it may be broadcast).  Grid observations: every event is one model reading at
grid point ``(event_id * 7919) mod 3157`` for the hour of ``ts``; readings of the
same (point, hour) collapse newest-``fetched_at``-wins, which is exactly the
keyed upsert (N1) applied to an append-only feed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..config import (
    GRID_LAT_MAX, GRID_LAT_MIN, GRID_LNG_MAX, GRID_LNG_MIN, GRID_STEP, OPENMETEO_CONFIDENCE, OPENMETEO_SOURCE,
    RASTER_CONFIDENCE, RASTER_SOURCE,
)
from ..operators.merge import latest_version
from .tables import read_table

N_LAT = int(round((GRID_LAT_MAX - GRID_LAT_MIN) / GRID_STEP)) + 1  # 77
N_LNG = int(round((GRID_LNG_MAX - GRID_LNG_MIN) / GRID_STEP)) + 1  # 41
N_POINTS = N_LAT * N_LNG
GRID_SPREAD = 7919  # prime multiplier spreading consecutive events over the lattice


def lattice(spark: SparkSession) -> DataFrame:
    """(i, j) -> (lat, lng) inclusive, rounded to 5 places; province band of 20 rows."""
    ij = spark.range(N_POINTS).select(
        (F.col("id") / N_LNG).cast("int").alias("i"), (F.col("id") % N_LNG).cast("int").alias("j")
    )
    return ij.select(
        (F.col("i") * N_LNG + F.col("j")).cast("int").alias("grid_point_id"),
        round_half_up(F.lit(GRID_LAT_MIN) + F.lit(GRID_STEP) * F.col("i"), 5).alias("lat"),
        round_half_up(F.lit(GRID_LNG_MIN) + F.lit(GRID_STEP) * F.col("j"), 5).alias("lng"),
        F.concat(F.lit("p"), (F.col("i") / 20).cast("int").cast("string")).alias("province_code"),
        F.concat(F.lit("Province "), (F.col("i") / 20).cast("int").cast("string")).alias("province_name"),
        F.lit(True).alias("is_land"),
        F.lit(True).alias("is_active"),
    )


def grid_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only model readings (may repeat a (point, hour) key)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    src = F.when(F.col("event_type") == "view", F.lit(RASTER_SOURCE)).otherwise(F.lit(OPENMETEO_SOURCE))
    return ev.select(
        F.col("event_id").alias("reading_id"),
        F.pmod(F.col("event_id") * GRID_SPREAD, F.lit(N_POINTS)).cast("int").alias("grid_point_id"),
        F.date_trunc("hour", F.col("ts")).alias("observed_at"),
        F.floor(F.col("value")).cast("int").alias("aqi"),
        (F.col("value") * 0.4).alias("pm25"),
        (F.col("value") * 0.8).alias("pm10"),
        src.alias("source_code"),
        F.when(src == RASTER_SOURCE, F.lit(RASTER_CONFIDENCE)).otherwise(F.lit(OPENMETEO_CONFIDENCE)).alias("confidence_score"),
        F.col("ts").alias("fetched_at"),
    )


def grid_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid observation table keyed by (grid_point_id, observed_at), newest fetch wins."""
    return latest_version(grid_readings(spark, sf_dir), ["grid_point_id", "observed_at"], ["fetched_at", "reading_id"])
