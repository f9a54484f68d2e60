"""Weather-model payloads (A7, A8) and gridded raster ingest.

The replaced service fetched one JSON document per grid point over HTTP.  Here
payloads are *landed* JSON strings (a file or stream source); ``normalise_payloads``
parses them with ``from_json``, coerces numbers tolerantly (bad strings and NaN
become NULL), drops rows without ``us_aqi`` and converts the naive local time
(fixed +07:00) to UTC; a document without a time counts for the time of its fetch.
``landed_payloads`` renders such documents from the driver's events so the parser
is exercised on data that grows with the tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..config import OPENMETEO_CONFIDENCE, OPENMETEO_SOURCE, RASTER_CONFIDENCE, RASTER_SOURCE
from ..functions import pm25_to_aqi
from .grid import GRID_SPREAD, N_POINTS
from .tables import read_table

# FIXED VALUES — payload field -> observation column
PAYLOAD_FIELDS = {
    "pm2_5": "pm25",
    "pm10": "pm10",
    "nitrogen_dioxide": "no2",
    "ozone": "o3",
    "sulphur_dioxide": "so2",
    "carbon_monoxide": "co",
}
LOCAL_UTC_OFFSET_HOURS = 7  # payload times are naive local time, suffixed "+07:00"

PAYLOAD_SCHEMA = (
    "grid_point_id int, fetched_at string, current struct<time: string, us_aqi: string, "
    + ", ".join(f"{k}: string" for k in PAYLOAD_FIELDS) + ">"
)


def opt_num(c: Column) -> Column:
    """None / NaN / non-numeric string -> NULL, else double."""
    d = c.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def landed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per event: (payload_id, json).  Errors carry no us_aqi; every 11th
    pm10 is the string 'n/a'; every 13th ozone is NaN; every 19th document has no time."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value", "props"])
    k = F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)")
    local = F.date_format(F.date_trunc("hour", F.col("ts")) + F.expr(f"INTERVAL {LOCAL_UTC_OFFSET_HOURS} HOURS"), "yyyy-MM-dd'T'HH:mm")
    v = F.col("value")
    cur = F.struct(
        F.when(F.col("event_id") % 19 != 0, local).alias("time"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double")).otherwise(v).alias("us_aqi"),
        (v * 0.4).alias("pm2_5"),
        F.when(F.col("event_id") % 11 == 0, F.lit("n/a")).otherwise((v * 0.8).cast("string")).alias("pm10"),
        (k * 0.5).alias("nitrogen_dioxide"),
        F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(k).alias("ozone"),
        (v * 0.1).alias("sulphur_dioxide"),
        F.lit(250.0).alias("carbon_monoxide"),
    )
    doc = F.struct(
        F.pmod(F.col("event_id") * GRID_SPREAD, F.lit(N_POINTS)).cast("int").alias("grid_point_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fetched_at"),
        cur.alias("current"),
    )
    return ev.select(F.col("event_id").alias("payload_id"), F.to_json(doc).alias("json"))


def normalise_payloads(payloads: DataFrame) -> DataFrame:
    """JSON payload -> grid observation rows."""
    p = payloads.select("payload_id", F.from_json("json", PAYLOAD_SCHEMA).alias("d"))
    cur = F.col("d.current")
    us_aqi = opt_num(cur["us_aqi"])
    fetched = F.to_timestamp_ntz(F.col("d.fetched_at"))
    local = F.to_timestamp_ntz(F.nullif(cur["time"], F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm"))
    out = p.select(
        "payload_id",
        F.col("d.grid_point_id").alias("grid_point_id"),
        F.coalesce(local - F.expr(f"INTERVAL {LOCAL_UTC_OFFSET_HOURS} HOURS"), fetched).alias("observed_at"),
        F.bround(us_aqi, 0).cast("int").alias("aqi"),
        *[opt_num(cur[src]).alias(dst) for src, dst in PAYLOAD_FIELDS.items()],
        F.lit(OPENMETEO_SOURCE).alias("source_code"),
        F.lit(OPENMETEO_CONFIDENCE).alias("confidence_score"),
        fetched.alias("fetched_at"),
        us_aqi.alias("_us_aqi"),
    )
    return out.filter(F.col("_us_aqi").isNotNull() & F.col("observed_at").isNotNull()).drop("_us_aqi")


# --- A9: gridded PM2.5 raster -> grid points ---------------------------------
RASTER_STEP = 0.5
RASTER_LAT0, RASTER_LON0 = 8.3, 101.3  # cell centres sit off the 0.2-degree grid lattice


def raster_from_readings(readings: DataFrame, points: DataFrame) -> DataFrame:
    """A PM2.5 raster (lat, lon, pm25) averaged from grid readings into 0.5-degree cells."""
    r = readings.join(points.select("grid_point_id", "lat", "lng"), "grid_point_id")
    ci = F.floor((F.col("lat") - (RASTER_LAT0 - RASTER_STEP / 2)) / RASTER_STEP).cast("int")
    cj = F.floor((F.col("lng") - (RASTER_LON0 - RASTER_STEP / 2)) / RASTER_STEP).cast("int")
    g = r.groupBy(ci.alias("ci"), cj.alias("cj")).agg(F.avg("pm25").alias("pm25"))
    return g.select(
        round_half_up(F.lit(RASTER_LAT0) + F.col("ci") * RASTER_STEP, 5).alias("lat"),
        round_half_up(F.lit(RASTER_LON0) + F.col("cj") * RASTER_STEP, 5).alias("lon"), "pm25",
    )


def _nearest_coord(x: Column, origin: float, step: float, lo: Column, hi: Column) -> Column:
    """Nearest coordinate of a regular raster axis (origin + step * i, i in [lo, hi]);
    ties go to the larger coordinate."""
    i = F.floor((x - F.lit(origin)) / F.lit(step) + F.lit(0.5))
    i = F.least(F.greatest(i, lo), hi)
    return round_half_up(F.lit(origin) + i * F.lit(step), 5)


def raster_to_points(raster: DataFrame, points: DataFrame, as_of: datetime, strict: bool = False) -> DataFrame:
    """Nearest raster cell per active land point (nearest lat and nearest lon are
    independent), PM2.5 -> AQI (H4), NULL dropped; source berkeley_earth, confidence 0.7."""
    from ..sources.binding import ts_lit

    p = points.filter("is_active AND is_land").select("grid_point_id", "lat", "lng")
    ii = round_half_up((F.col("lat") - RASTER_LAT0) / RASTER_STEP)
    jj = round_half_up((F.col("lon") - RASTER_LON0) / RASTER_STEP)
    i0, i1 = raster.agg(F.min(ii)).scalar(), raster.agg(F.max(ii)).scalar()  # raster extent: scalar subqueries
    j0, j1 = raster.agg(F.min(jj)).scalar(), raster.agg(F.max(jj)).scalar()
    p = p.select(
        "grid_point_id",
        _nearest_coord(F.col("lat"), RASTER_LAT0, RASTER_STEP, i0, i1).alias("r_lat"),
        _nearest_coord(F.col("lng"), RASTER_LON0, RASTER_STEP, j0, j1).alias("r_lon"),
    )
    cells = raster.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "pm25")
    j = p.join(cells, ["r_lat", "r_lon"])  # cells without data (NaN in the file) are absent
    aqi = pm25_to_aqi(F.col("pm25"), strict=strict)
    return j.select(
        "grid_point_id", F.date_trunc("hour", ts_lit(as_of)).alias("observed_at"), aqi.alias("aqi"), "pm25",
        F.lit(RASTER_SOURCE).alias("source_code"), F.lit(RASTER_CONFIDENCE).alias("confidence_score"),
    ).filter(F.col("aqi").isNotNull())
