"""Spatial grid pipeline: seed (A11 + C17 + H16), IDW fusion (K1, K2), serve (K4),
stats (K6), health (K7).

Fusion joins grid points to stations through ``within_km_join`` (cell-bucketed,
exact haversine), aggregates the inverse-distance weights per grid point (D16)
and writes back with a keyed update (N2).  No grid x station Cartesian product.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (
    CONFIDENCE_DIVISOR, FUSION_BASE_WEIGHT, FUSION_GRID_MAX_AGE_HOURS, FUSION_MAX_DIST_KM,
    FUSION_STATION_MAX_AGE_HOURS, FRESH_HOURS, GRID_LATEST_MAX_AGE_HOURS, OPENMETEO_SOURCE, RASTER_SOURCE,
)
from ..functions import freshness_status, hours_between, idw_weight
from ..operators import latest_per_key
from ..operators.merge import keyed_update
from ..operators.spatial import within_km_join
from ..sources.binding import ts_lit
from .common import window

BASELINE_SOURCES = [OPENMETEO_SOURCE, RASTER_SOURCE]


def land_points(points: DataFrame) -> DataFrame:
    return points.filter("is_active AND is_land")


def latest_grid(obs: DataFrame, points: DataFrame, as_of: datetime, max_age_hours: float = FUSION_GRID_MAX_AGE_HOURS,
                sources: list[str] | None = BASELINE_SOURCES) -> DataFrame:
    """Latest non-null observation per active land point within ``max_age_hours``."""
    o = window(obs, as_of, hours=max_age_hours)
    if sources is not None:  # T17: fuse baseline rows only (None = any source, as the replaced job)
        if "base_source" in o.columns:  # fused before: the baseline is what the first run started from
            fused = F.col("base_source").isNotNull()
            o = o.withColumn("aqi", F.when(fused, F.col("base_aqi")).otherwise(F.col("aqi")))
            o = o.withColumn("source_code", F.coalesce("base_source", "source_code"))
        o = o.filter(F.col("source_code").isin(sources))
    o = o.filter(F.col("aqi").isNotNull()).join(land_points(points).select("grid_point_id"), "grid_point_id", "left_semi")
    last = latest_per_key(o, ["grid_point_id"], ["observed_at"], ["observed_at", "aqi", "source_code"])
    return last.join(points.select("grid_point_id", "lat", "lng"), "grid_point_id")


def latest_station_aqi(aq: DataFrame, stations: DataFrame, as_of: datetime,
                       max_age_hours: float = FUSION_STATION_MAX_AGE_HOURS) -> DataFrame:
    a = window(aq, as_of, hours=max_age_hours).filter(F.col("aqi").isNotNull())
    act = stations.filter("is_active").select("station_id", "lat", "lng")
    last = latest_per_key(a.join(act.select("station_id"), "station_id", "left_semi"), ["station_id"],
                          ["observed_at", "obs_id"], ["aqi"])
    return last.join(act, "station_id")


def fuse(grid_latest: DataFrame, station_latest: DataFrame, strict: bool = False) -> DataFrame:
    """K1 for every grid point: base weight 1 x grid AQI + 3/d^2 (100 under 0.1 km) per station
    closer than 30 km.  Rows: grid_point_id, observed_at, base_aqi, aqi, confidence_score,
    source_code, source_count."""
    st = station_latest.select("station_id", F.col("aqi").alias("s_aqi"), "lat", "lng")
    g = grid_latest.select("grid_point_id", "lat", "lng")
    pairs = within_km_join(g, st, FUSION_MAX_DIST_KM)
    contrib = pairs.withColumn("w", idw_weight(F.col("dist_km"))).groupBy("grid_point_id").agg(
        F.sum(F.col("s_aqi") * F.col("w")).alias("_ws"), F.sum("w").alias("_tw"), F.count(F.lit(1)).alias("_n")
    )
    j = grid_latest.join(contrib, "grid_point_id", "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    ws = F.col("aqi") * F.lit(FUSION_BASE_WEIGHT) + F.coalesce(F.col("_ws"), F.lit(0.0))
    tw = F.lit(FUSION_BASE_WEIGHT) + F.coalesce(F.col("_tw"), F.lit(0.0))
    keep_src = F.lit(OPENMETEO_SOURCE) if strict else F.col("source_code")
    return j.select(
        "grid_point_id", "observed_at", F.col("aqi").alias("base_aqi"),
        F.bround(ws / tw, 0).cast("int").alias("aqi"),
        F.bround(F.least(F.lit(1.0), tw / CONFIDENCE_DIVISOR), 2).alias("confidence_score"),
        F.when(n > 0, F.lit("fused")).otherwise(keep_src).alias("source_code"),
        (n + 1).cast("int").alias("source_count"),
    )


def run_grid_fusion(obs: DataFrame, points: DataFrame, aq: DataFrame, stations: DataFrame, as_of: datetime,
                    strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """K2: returns (fused rows, observation table with the fused rows written back in place).  The
    table keeps the value and source that a row had before fusion (``base_aqi``, ``base_source``), so
    that a later run starts from them; ``strict`` fuses whatever value stands there."""
    gl = latest_grid(obs, points, as_of, sources=None if strict else BASELINE_SOURCES)
    fused = fuse(gl, latest_station_aqi(aq, stations, as_of), strict=strict)
    upd = fused.select("grid_point_id", "observed_at", "aqi", "source_code", "confidence_score",
                       ts_lit(as_of).alias("fetched_at"))
    cols = ["aqi", "source_code", "confidence_score", "fetched_at"]
    if not strict:
        base = gl.select("grid_point_id", F.col("aqi").alias("base_aqi"), F.col("source_code").alias("base_source"))
        upd = upd.join(base, "grid_point_id")
        for c, t in (("base_aqi", "int"), ("base_source", "string")):
            obs = obs if c in obs.columns else obs.withColumn(c, F.lit(None).cast(t))
        cols += ["base_aqi", "base_source"]
    return fused, keyed_update(obs, upd, ["grid_point_id", "observed_at"], cols)


def grid_latest(obs: DataFrame, points: DataFrame, as_of: datetime, bounds: str | None = None,
                province: str | None = None, max_age_hours: int = GRID_LATEST_MAX_AGE_HOURS) -> DataFrame:
    """K4: latest observation per active land point inside ``bounds`` ('lat_min,lng_min,lat_max,lng_max')
    and/or ``province``; points whose latest row has no AQI are dropped after the pick."""
    if not 1 <= max_age_hours <= 72:
        raise ValueError("max_age_hours must be within 1..72")
    p = land_points(points)
    if bounds:
        try:
            lat_min, lng_min, lat_max, lng_max = (float(x) for x in bounds.split(","))
        except ValueError as e:
            raise ValueError("bounds must be 'lat_min,lng_min,lat_max,lng_max'") from e
        p = p.filter(F.col("lat").between(lat_min, lat_max) & F.col("lng").between(lng_min, lng_max))
    if province:
        p = p.filter(F.col("province_code") == province)
    o = window(obs, as_of, hours=max_age_hours).join(p.select("grid_point_id"), "grid_point_id", "left_semi")
    last = latest_per_key(o, ["grid_point_id"], ["observed_at"],
                          ["observed_at", "aqi", "pm25", "pm10", "source_code", "confidence_score"])
    out = p.select("grid_point_id", "lat", "lng", "province_code", "province_name").join(last, "grid_point_id", "left")
    return out.filter(F.col("aqi").isNotNull())


def grid_stats(obs: DataFrame, points: DataFrame, as_of: datetime) -> DataFrame:
    """K6: one row per source (count, first, last) with the coverage totals repeated."""
    o = obs.filter(F.col("observed_at") <= ts_lit(as_of))
    total = land_points(points).agg(F.count(F.lit(1)).alias("total_grid_points"))
    fresh = window(o, as_of, hours=FRESH_HOURS).agg(F.countDistinct("grid_point_id").alias("fresh_within_6h"))
    by_src = o.groupBy("source_code").agg(
        F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at")
    )
    # total and fresh are scalar subqueries (evaluated once, no join)
    return by_src.select("*", total.scalar().alias("total_grid_points"), fresh.scalar().alias("fresh_within_6h"))


def grid_health(obs: DataFrame, points: DataFrame, as_of: datetime) -> DataFrame:
    """K7: status of the latest observation of each active land point, counted (D19 pivot)."""
    o = obs.filter(F.col("observed_at") <= ts_lit(as_of))
    last = latest_per_key(o, ["grid_point_id"], ["observed_at"], ["observed_at"])
    p = land_points(points).select("grid_point_id").join(last, "grid_point_id", "left")
    st = p.select(freshness_status(hours_between(ts_lit(as_of), F.col("observed_at"))).alias("status"))
    labels = ["fresh", "stale", "expired", "no_data"]
    piv = st.groupBy().pivot("status", labels).count()
    cols = [F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in labels]
    out = piv.select(*cols)
    return out.withColumn("total", sum((F.col(s) for s in labels), F.lit(0)).cast("long"))


# --- seeding: polygons (A10) and point-in-polygon (C17) ---------------------

#: Height of the latitude bands that edges are listed under.
BAND_DEG = 0.1


def polygon_edges(rings: DataFrame) -> DataFrame:
    """rings(polygon_id, ring, seq, lng, lat) -> edges(polygon_id, x1, y1, x2, y2) of closed rings."""
    from pyspark.sql import Window

    w = Window.partitionBy("polygon_id", "ring").orderBy("seq")
    nxt = rings.withColumn("x2", F.lead("lng").over(w)).withColumn("y2", F.lead("lat").over(w))
    first = rings.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        "polygon_id", "ring", F.col("lng").alias("fx"), F.col("lat").alias("fy"))
    e = nxt.join(first, ["polygon_id", "ring"])
    return e.select("polygon_id", F.col("lng").alias("x1"), F.col("lat").alias("y1"),
                    F.coalesce("x2", "fx").alias("x2"), F.coalesce("y2", "fy").alias("y2"))


def point_in_polygon(points: DataFrame, polygons: DataFrame, edges: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """C17: for each point (grid_point_id, lat, lng), the first polygon (lowest ``sort_order``)
    that contains it, by even-odd ray casting over all rings (holes excluded).
    Candidate polygons come from a cell-bucketed bbox join, not a Cartesian product, and a point
    meets only the edges that cross its band of latitude, not all edges of its candidates."""
    bbox = edges.groupBy("polygon_id").agg(
        F.least(F.min("y1"), F.min("y2")).alias("lat0"), F.greatest(F.max("y1"), F.max("y2")).alias("lat1"),
        F.least(F.min("x1"), F.min("x2")).alias("lng0"), F.greatest(F.max("x1"), F.max("x2")).alias("lng1"),
    )
    cells = bbox.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("lat0") / cell_deg), F.floor(F.col("lat1") / cell_deg)))) \
        .withColumn("_cx", F.explode(F.sequence(F.floor(F.col("lng0") / cell_deg), F.floor(F.col("lng1") / cell_deg))))
    pts = points.withColumn("_cy", F.floor(F.col("lat") / cell_deg)).withColumn("_cx", F.floor(F.col("lng") / cell_deg))
    cand = pts.join(cells, ["_cy", "_cx"]).filter(
        F.col("lat").between(F.col("lat0"), F.col("lat1")) & F.col("lng").between(F.col("lng0"), F.col("lng1"))
    ).select("grid_point_id", "lat", "lng", "polygon_id")
    x, y = F.col("lng"), F.col("lat")
    cross = ((F.col("y1") > y) != (F.col("y2") > y)) & (
        x < (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    band = lambda c: F.floor(c / BAND_DEG)
    # a level edge crosses no ray; the others are listed under every band they reach
    banded = edges.where("y1 <> y2").withColumn("_band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    par = cand.withColumn("_band", band(y)).join(banded, ["polygon_id", "_band"]).groupBy("grid_point_id", "polygon_id").agg(
        F.sum(F.when(cross, 1).otherwise(0)).alias("_c"))
    inside = par.filter(F.col("_c") % 2 == 1).join(polygons.select("polygon_id", "sort_order", "name"), "polygon_id")
    return inside.groupBy("grid_point_id").agg(
        F.min_by(F.struct("polygon_id", "name"), F.struct("sort_order", "polygon_id")).alias("_p")
    ).select("grid_point_id", F.col("_p.polygon_id").alias("polygon_id"), F.col("_p.name").alias("province_name"))


def seed_grid_points(points: DataFrame, seeded: DataFrame) -> DataFrame:
    """K3 final step: upsert seeded points (grid_point_id, province_name, province_code) into the
    grid-point table keyed by (lat, lng); seeded points become land with their province,
    the others keep their row."""
    from ..operators.merge import keyed_merge

    new = points.join(seeded.select("grid_point_id", F.col("province_name").alias("_pn"), F.col("province_code").alias("_pc")),
                      "grid_point_id").select(
        "grid_point_id", "lat", "lng", F.col("_pc").alias("province_code"), F.col("_pn").alias("province_name"),
        F.lit(True).alias("is_land"), "is_active")
    return keyed_merge(points.select(*new.columns), new, ["lat", "lng"])
