"""Registered queries: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables through ``sources.binding`` (so its work
grows with them) and returns a canonical projection: timestamps as
'yyyy-MM-dd HH:mm:ss' strings, dates as strings, integers as BIGINT.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.numeric import round_half_up
from .config import GBT_PARAMS
from .sources.binding import AS_OF, Bound

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def canon(df: DataFrame) -> DataFrame:
    from .session import pin_utc

    pin_utc(df.sparkSession)  # hour/day boundaries and interval arithmetic are UTC for every query
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# --- I1 -------------------------------------------------------------------
@register("daily_summary")
def q_daily_summary(spark, sf_dir):
    from .plans.daily_summary import daily_summary

    b = Bound(spark, sf_dir)
    return canon(daily_summary(b.aq, b.wx, b.stations, end=(AS_OF - timedelta(days=1)).date()))


@register("daily_summary_yesterday")
def q_daily_summary_yesterday(spark, sf_dir):
    from .plans.daily_summary import summary_of_day

    b = Bound(spark, sf_dir)
    return canon(summary_of_day(b.aq, b.wx, b.stations, AS_OF))


@register("daily_summary_strict")
def q_daily_summary_strict(spark, sf_dir):
    from .plans.daily_summary import daily_summary

    b = Bound(spark, sf_dir)
    return canon(daily_summary(b.aq, b.wx, b.stations, end=(AS_OF - timedelta(days=1)).date(), strict=True))


SCAN_HOURS = 24  # FIXTURES: a 24-hour anomaly scan gives enough candidates at sf0.01


def _round_value(df, col="value", digits=4):
    return df.withColumn(col, round_half_up(F.col(col), digits))


# --- I2 -------------------------------------------------------------------
@register("anomaly_candidates")
def q_anomaly_candidates(spark, sf_dir):
    from .plans.anomaly import detect_anomalies

    b = Bound(spark, sf_dir)
    return canon(_round_value(detect_anomalies(b.aq, b.stations, AS_OF, scan_hours=SCAN_HOURS).drop("description")))


@register("anomaly_descriptions")
def q_anomaly_descriptions(spark, sf_dir):
    """The text of every anomaly with its severity."""
    from .plans.anomaly import detect_anomalies

    b = Bound(spark, sf_dir)
    return canon(detect_anomalies(b.aq, b.stations, AS_OF, scan_hours=SCAN_HOURS).select("obs_id", "metric", "severity", "description"))


@register("anomaly_suppressed")
def q_anomaly_suppressed(spark, sf_dir):
    """Re-run 12 h later: candidates already reported (or near a reported one) are suppressed."""
    from .plans.anomaly import detect_anomalies

    b = Bound(spark, sf_dir)
    prior = detect_anomalies(b.aq, b.stations, AS_OF - timedelta(hours=12), scan_hours=SCAN_HOURS)
    cur = detect_anomalies(b.aq, b.stations, AS_OF, scan_hours=SCAN_HOURS, prior=prior)
    return canon(_round_value(cur.drop("description")))


# --- I3 -------------------------------------------------------------------
@register("seasonal_hourly")
def q_seasonal_hourly(spark, sf_dir):
    from .plans.seasonal import hourly_profile

    b = Bound(spark, sf_dir)
    return canon(hourly_profile(b.aq, b.stations, AS_OF, "aqi"))


@register("seasonal_dow")
def q_seasonal_dow(spark, sf_dir):
    from .plans.seasonal import dow_profile

    b = Bound(spark, sf_dir)
    return canon(dow_profile(b.aq, b.stations, AS_OF, "pm25"))


@register("seasonal_peaks")
def q_seasonal_peaks(spark, sf_dir):
    from .plans.seasonal import seasonal_summary

    b = Bound(spark, sf_dir)
    s = seasonal_summary(b.aq, b.stations, AS_OF, "aqi")
    return canon(s.select(
        "station_id", "metric",
        F.array_join(F.transform("peak_hours", lambda h: h.cast("string")), ",").alias("peak_hours"),
        F.array_join(F.transform("off_peak_hours", lambda h: h.cast("string")), ",").alias("off_peak_hours"),
        "best_dow", "worst_dow", "overall_avg", "hourly_variation",
    ))


# --- I5 -------------------------------------------------------------------
@register("trend")
def q_trend(spark, sf_dir):
    from .plans.trend import trend_analysis

    b = Bound(spark, sf_dir)
    return canon(trend_analysis(b.aq, b.stations, AS_OF))


# --- I6 -------------------------------------------------------------------
def _health(spark, sf_dir, strict=False):
    from .plans.health import health_impact

    b = Bound(spark, sf_dir)
    return health_impact(b.aq, b.stations, AS_OF, strict=strict)


@register("health_impact")
def q_health_impact(spark, sf_dir):
    return canon(_health(spark, sf_dir).drop("time_in_levels", "pollutant_averages"))


@register("health_impact_strict")
def q_health_impact_strict(spark, sf_dir):
    return canon(_health(spark, sf_dir, strict=True).drop("time_in_levels", "pollutant_averages"))


@register("health_time_in_levels")
def q_health_time_in_levels(spark, sf_dir):
    h = _health(spark, sf_dir)
    return canon(h.select("station_id", F.explode("time_in_levels").alias("level", "hours")))


@register("health_pollutant_averages")
def q_health_pollutant_averages(spark, sf_dir):
    h = _health(spark, sf_dir)
    e = h.select("station_id", "dominant_pollutant", F.explode("pollutant_averages").alias("pollutant", "avg_value"))
    return canon(e.withColumn("avg_value", round_half_up("avg_value", 4)))


# --- I4 -------------------------------------------------------------------
def _corr(spark, sf_dir, positional, parts):
    from .plans.correlation import correlation_matrix

    b = Bound(spark, sf_dir)
    return correlation_matrix(b.aq, b.wx, b.stations, AS_OF, positional=positional, parts=parts)


@register("correlation_aq_aq")
def q_correlation_aq_aq(spark, sf_dir):
    return canon(_corr(spark, sf_dir, False, ("aq_aq",)))


@register("correlation_weather_zip")
def q_correlation_weather_zip(spark, sf_dir):
    return canon(_corr(spark, sf_dir, True, ("aq_weather",)))


@register("correlation_weather_hourly")
def q_correlation_weather_hourly(spark, sf_dir):
    return canon(_corr(spark, sf_dir, False, ("aq_weather",)))


# --- L1, L3, L11-L16 ------------------------------------------------------
@register("station_latest")
def q_station_latest(spark, sf_dir):
    from .plans.views import station_latest_air_quality

    b = Bound(spark, sf_dir)
    return canon(station_latest_air_quality(b.aq, b.wx, b.stations, AS_OF).withColumn("pm25", round_half_up("pm25", 4))
                 .withColumn("pm10", round_half_up("pm10", 4)).withColumn("no2", round_half_up("no2", 4))
                 .withColumn("temperature_c", round_half_up("temperature_c", 4)).withColumn("wind_speed_mps", round_half_up("wind_speed_mps", 4)))


@register("station_latest_own_weather")
def q_station_latest_own_weather(spark, sf_dir):
    """L1 where some air-quality rows carry weather of their own, which goes before the weather fact's."""
    from .plans.views import station_latest_air_quality

    b = Bound(spark, sf_dir)
    own = F.when(F.col("obs_id") % 2 == 0, F.col("so2"))
    aq = b.aq.withColumn("temperature_c", own + 10).withColumn("humidity_pct", own * 2)
    weather = ["temperature_c", "humidity_pct", "wind_speed_mps"]
    return canon(station_latest_air_quality(aq, b.wx, b.stations, AS_OF).select(
        "station_id", "observed_at", *[round_half_up(c, 4).alias(c) for c in weather]))


@register("station_source_latest")
def q_station_source_latest(spark, sf_dir):
    from .plans.views import station_source_latest

    b = Bound(spark, sf_dir)
    return canon(station_source_latest(b.aq, b.stations, AS_OF))


@register("station_24h")
def q_station_24h(spark, sf_dir):
    from .plans.views import station_24h_summary

    b = Bound(spark, sf_dir)
    return canon(station_24h_summary(b.aq, b.stations, AS_OF))


@register("simple_forecast")
def q_simple_forecast(spark, sf_dir):
    from .plans.views import simple_forecast

    b = Bound(spark, sf_dir)
    return canon(simple_forecast(b.aq, AS_OF))


@register("station_analytics")
def q_station_analytics(spark, sf_dir):
    from .plans.views import station_analytics

    b = Bound(spark, sf_dir)
    df = station_analytics(b.aq, b.wx, b.stations, AS_OF)
    for c in ["pm25", "pm10", "no2", "temperature_c", "wind_speed_mps"]:
        df = df.withColumn(c, round_half_up(c, 4))
    return canon(df)


@register("fused_observations")
def q_fused_observations(spark, sf_dir):
    from .plans.views import fused_observations

    b = Bound(spark, sf_dir)
    df = fused_observations(b.aq)
    for c in ["pm25", "pm10", "no2"]:
        df = df.withColumn(c, round_half_up(c, 4))
    return canon(df)


@register("source_compare")
def q_source_compare(spark, sf_dir):
    from .plans.views import source_compare

    b = Bound(spark, sf_dir)
    df = source_compare(b.aq, b.stations)
    for c in ["pm25", "pm10", "no2"]:
        df = df.withColumn(c, round_half_up(c, 4))
    return canon(df)


@register("source_bindings")
def q_source_bindings(spark, sf_dir):
    """Bind the waqi endpoint to every active station, skipping stations whose binding
    is live (existing = (station, endpoint) pairs that delivered rows in the last 2 hours)."""
    from .plans.common import window
    from .plans.views import generate_bindings

    b = Bound(spark, sf_dir)
    existing = window(b.aq, AS_OF, hours=2).select("station_id", "endpoint_code").distinct()
    return canon(generate_bindings(b.stations, existing, AS_OF, endpoint="waqi_hourly"))


# --- spatial grid (A11, C13, C17, K1-K7) -------------------------------------
def _grid(spark, sf_dir):
    from .sources.grid import grid_observations, lattice

    return lattice(spark), grid_observations(spark, sf_dir)


@register("grid_lattice")
def q_grid_lattice(spark, sf_dir):
    """A11 lattice with the number of observations each point received."""
    pts, obs = _grid(spark, sf_dir)
    n = obs.groupBy("grid_point_id").agg(F.count(F.lit(1)).alias("n_obs"))
    return canon(pts.join(n, "grid_point_id", "left").select(
        "grid_point_id", "lat", "lng", "province_code", F.coalesce("n_obs", F.lit(0)).alias("n_obs")))


@register("grid_provinces")
def q_grid_provinces(spark, sf_dir):
    """K3 seeding: observed lattice points -> first containing nation polygon (C17) -> slug."""
    from .functions import slugify_vi
    from .plans.grid import point_in_polygon, polygon_edges
    from .sources.polygons import nation_polygons

    pts, obs = _grid(spark, sf_dir)
    seen = pts.join(obs.select("grid_point_id").distinct(), "grid_point_id", "left_semi").select("grid_point_id", "lat", "lng")
    polys, rings = nation_polygons(spark, sf_dir)
    got = point_in_polygon(seen, polys, polygon_edges(rings))
    return canon(got.withColumn("province_code", slugify_vi(F.col("province_name"))))


def _geojson(spark, sf_dir):
    """The nation polygons landed as GeoJSON, one collection a region, and read back (A10)."""
    from .sources.polygons import nation_polygons, read_geojson_polygons, write_geojson
    from .sources.tables import read_table
    from .streaming.jobs import stream_root

    path = f"{stream_root(spark, 'geojson')}/provinces"
    polys, rings = nation_polygons(spark, sf_dir)
    region = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"]).select(
        F.col("n_nationkey").cast("int").alias("polygon_id"), F.col("n_regionkey").alias("region"))
    write_geojson(polys.join(region, "polygon_id"), rings, path, "region")
    return read_geojson_polygons(spark, path)


@register("geojson_polygons")
def q_geojson_polygons(spark, sf_dir):
    """A10: vertices of the landed collections, polygons numbered by file and place."""
    polys, rings = _geojson(spark, sf_dir)
    return canon(polys.join(rings, "polygon_id").select("polygon_id", "name", "ring", "seq", "lng", "lat"))


@register("geojson_provinces")
def q_geojson_provinces(spark, sf_dir):
    """A10 and C17: observed lattice points with the province of the landed collections."""
    from .plans.grid import point_in_polygon, polygon_edges

    pts, obs = _grid(spark, sf_dir)
    seen = pts.join(obs.select("grid_point_id").distinct(), "grid_point_id", "left_semi").select("grid_point_id", "lat", "lng")
    polys, rings = _geojson(spark, sf_dir)
    return canon(point_in_polygon(seen, polys, polygon_edges(rings)))


def _fusion(spark, sf_dir):
    from .plans.grid import run_grid_fusion

    pts, obs = _grid(spark, sf_dir)
    b = Bound(spark, sf_dir)
    return pts, obs, run_grid_fusion(obs, pts, b.aq, b.stations, AS_OF)


@register("grid_fusion")
def q_grid_fusion(spark, sf_dir):
    _, _, (fused, _) = _fusion(spark, sf_dir)
    return canon(fused)


@register("grid_fusion_twice")
def q_grid_fusion_twice(spark, sf_dir):
    """K2 on a table that a run before it has fused: the same rows again."""
    from .plans.grid import run_grid_fusion

    pts, _, (_, applied) = _fusion(spark, sf_dir)
    b = Bound(spark, sf_dir)
    return canon(run_grid_fusion(applied, pts, b.aq, b.stations, AS_OF)[0])


@register("grid_fusion_any_source")
def q_grid_fusion_any_source(spark, sf_dir):
    """K2 as the replaced job ran it: a second run fuses what the first one wrote, whatever its source."""
    from .plans.grid import run_grid_fusion

    pts, obs = _grid(spark, sf_dir)
    b = Bound(spark, sf_dir)
    _, applied = run_grid_fusion(obs, pts, b.aq, b.stations, AS_OF, strict=True)
    return canon(run_grid_fusion(applied, pts, b.aq, b.stations, AS_OF, strict=True)[0])


@register("grid_latest")
def q_grid_latest(spark, sf_dir):
    from .plans.grid import grid_latest

    pts, _, (_, applied) = _fusion(spark, sf_dir)
    df = grid_latest(applied, pts, AS_OF, bounds="10.0,103.0,20.0,108.0", max_age_hours=12)
    return canon(df.withColumn("pm25", round_half_up("pm25", 4)).withColumn("pm10", round_half_up("pm10", 4)))


@register("grid_stats")
def q_grid_stats(spark, sf_dir):
    from .plans.grid import grid_stats

    pts, _, (_, applied) = _fusion(spark, sf_dir)
    return canon(grid_stats(applied, pts, AS_OF))


@register("grid_health")
def q_grid_health(spark, sf_dir):
    from .plans.grid import grid_health

    pts, _, (_, applied) = _fusion(spark, sf_dir)
    return canon(grid_health(applied, pts, AS_OF))


# --- forecasting (D18, E4-E6, H9, I7, J1-J7) ----------------------------------
@register("hourly_resample")
def q_hourly_resample(spark, sf_dir):
    from .plans.forecast import hourly_series

    b = Bound(spark, sf_dir)
    return canon(hourly_series(b.aq, b.stations, AS_OF, "pm25", 14).withColumn("y", round_half_up("y", 4)))


@register("forecast_features")
def q_forecast_features(spark, sf_dir):
    from .plans.forecast import FEATURES, forecast_features, hourly_series

    b = Bound(spark, sf_dir)
    df = forecast_features(hourly_series(b.aq, b.stations, AS_OF, "aqi", 14))
    return canon(df.select("station_id", "ts", round_half_up("y", 4).alias("y"),
                           *[round_half_up(c, 4).alias(c) if c not in ("hour", "day_of_week") else F.col(c) for c in FEATURES]))


@register("forecast_evaluation")
def q_forecast_evaluation(spark, sf_dir):
    from .plans.forecast import hourly_series, seasonal_naive_evaluation

    b = Bound(spark, sf_dir)
    return canon(seasonal_naive_evaluation(hourly_series(b.aq, b.stations, AS_OF, "aqi", 14)))


def _fc(spark, sf_dir, model):
    from .plans.forecast import run_forecast

    b = Bound(spark, sf_dir)
    return run_forecast(b.aq, b.stations, AS_OF, model, "aqi")


@register("forecast_linear")
def q_forecast_linear(spark, sf_dir):
    return canon(_fc(spark, sf_dir, "linear"))


@register("forecast_linear_model")
def q_forecast_linear_model(spark, sf_dir):
    from .plans.forecast import forecast_features, hourly_series
    from .plans.linear_model import FEATURES, linear_model
    from .session import cut_lineage

    b = Bound(spark, sf_dir)
    df = linear_model(forecast_features(cut_lineage(hourly_series(b.aq, b.stations, AS_OF, "aqi", 14))))
    return canon(df.select("station_id", "training_rows", "mae", "rmse", "mape",
                           *[F.bround(c, 4).alias(c) for c in ("spread", "intercept", *FEATURES)]))


@register("forecast_arima")
def q_forecast_arima(spark, sf_dir):
    return canon(_fc(spark, sf_dir, "arima"))


@register("forecast_seasonal")
def q_forecast_seasonal(spark, sf_dir):
    return canon(_fc(spark, sf_dir, "prophet"))


@register("forecast_runs")
def q_forecast_runs(spark, sf_dir):
    from .plans.forecast import forecast_runs

    pts = _fc(spark, sf_dir, "linear").unionByName(_fc(spark, sf_dir, "arima")).unionByName(_fc(spark, sf_dir, "prophet"))
    return canon(forecast_runs(pts))


@register("forecast_compare")
def q_forecast_compare(spark, sf_dir):
    from .plans.forecast import compare_models

    pts = _fc(spark, sf_dir, "linear").unionByName(_fc(spark, sf_dir, "arima")).unionByName(_fc(spark, sf_dir, "prophet"))
    return canon(compare_models(pts).drop("points"))


# --- grid ML (C14-C16, J8-J14) -------------------------------------------------
def _r4tie(c):
    """Presentation rounding to 4 places (exact decimal ties round away from zero)."""
    return round_half_up(F.col(c), 4).alias(c)

@register("knn_training_features")
def q_knn_training_features(spark, sf_dir):
    from .plans.grid_ml import training_frame

    b = Bound(spark, sf_dir)
    df = training_frame(b.aq, b.wx, b.stations, AS_OF)
    return canon(df.select(*[_r4tie(c) if t == "double" else F.col(c) for c, t in df.dtypes]))


@register("knn_inference_features")
def q_knn_inference_features(spark, sf_dir):
    from .plans.grid_ml import inference_frame
    from .sources.grid import lattice

    b = Bound(spark, sf_dir)
    df = inference_frame(b.aq, b.wx, b.stations, lattice(spark), AS_OF)
    return canon(df.select(*[_r4tie(c) if t == "double" else F.col(c) for c, t in df.dtypes]))


def _ml_train(spark, sf_dir, model_dir=None, champion=None):
    from .plans import grid_ml

    b = Bound(spark, sf_dir)
    return grid_ml.run_grid_training(b.aq, b.wx, b.stations, AS_OF, params=GBT_PARAMS, model_dir=model_dir, champion=champion)


@register("grid_ml_folds")
def q_grid_ml_folds(spark, sf_dir):
    """Stations of the training frame with their rows and fold, the largest to the lightest fold."""
    from .plans.grid_ml import station_folds, training_frame
    from .session import cut_lineage

    b = Bound(spark, sf_dir)
    train = cut_lineage(training_frame(b.aq, b.wx, b.stations, AS_OF).select("station_id"))
    _, folds = station_folds(train)
    return canon(train.groupBy("station_id").agg(F.count(F.lit(1)).alias("n")).join(folds, "station_id"))


@register("grid_ml_promotion")
def q_grid_ml_promotion(spark, sf_dir):
    """J12 over two runs: the first has no champion and is stored; the second, on the same readings, does
    not beat it by the margin, so the stored model stays."""
    from .plans.grid_ml import champion_meta
    from .session import ensure_checkpoint_dir

    model_dir = f"{ensure_checkpoint_dir(spark).rstrip('/')}/grid-ml-{uuid.uuid4().hex}"
    _, first = _ml_train(spark, sf_dir, model_dir)
    stored = champion_meta(spark, model_dir)
    _, second = _ml_train(spark, sf_dir, model_dir, stored)
    runs = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    return canon(runs.select("run", "cv_kind", "folds", "sample_count", "promoted", (F.col("champion_mae_before") == stored.agg(F.max("mae")).scalar()).alias("against_stored")))


@register("grid_ml_cv")
def q_grid_ml_cv(spark, sf_dir):
    """Station-grouped CV metrics of the challenger and the promotion decision."""
    _, meta = _ml_train(spark, sf_dir)
    return canon(meta)


@register("grid_ml_predict")
def q_grid_ml_predict(spark, sf_dir):
    """Champion predictions for every grid point, upserted into the grid observations."""
    from .operators.merge import keyed_merge
    from .plans.grid_ml import inference_frame, load_champion, predict_grid
    from .session import ensure_checkpoint_dir
    from .sources.grid import grid_observations, lattice

    b = Bound(spark, sf_dir)
    model_dir = f"{ensure_checkpoint_dir(spark).rstrip('/')}/grid-ml-{uuid.uuid4().hex}"
    _ml_train(spark, sf_dir, model_dir)
    model, mae = load_champion(spark, model_dir)
    pts = lattice(spark)
    pred = predict_grid(model, inference_frame(b.aq, b.wx, b.stations, pts, AS_OF), AS_OF, mae)
    obs = grid_observations(spark, sf_dir).select("grid_point_id", "observed_at", "aqi", "source_code", "confidence_score")
    merged = keyed_merge(obs, pred, ["grid_point_id", "observed_at"])
    return canon(merged.join(pred.select("grid_point_id", "observed_at"), ["grid_point_id", "observed_at"], "left_semi"))


# --- ingest and sinks (A7-A9, H4, N1-N3, B8) -------------------------------------
SPLIT_AT = "2024-01-15 00:00:00"  # existing table = readings fetched before, new batch = after


@register("payload_normalise")
def q_payload_normalise(spark, sf_dir):
    from .sources.payload import landed_payloads, normalise_payloads

    df = normalise_payloads(landed_payloads(spark, sf_dir))
    for c in ["pm25", "pm10", "no2", "o3", "so2", "co"]:
        df = df.withColumn(c, round_half_up(c, 4))
    return canon(df)


@register("pm25_to_aqi")
def q_pm25_to_aqi(spark, sf_dir):
    from .functions import pm25_to_aqi

    b = Bound(spark, sf_dir)
    return canon(b.aq.select("obs_id", round_half_up("pm25", 4).alias("pm25"), pm25_to_aqi(F.col("pm25")).alias("aqi_epa"),
                             pm25_to_aqi(F.col("pm25"), strict=True).alias("aqi_strict")))


@register("raster_nearest")
def q_raster_nearest(spark, sf_dir):
    from .sources.grid import grid_readings, lattice
    from .sources.payload import raster_from_readings, raster_to_points

    pts = lattice(spark)
    raster = raster_from_readings(grid_readings(spark, sf_dir), pts)
    return canon(raster_to_points(raster, pts, AS_OF).withColumn("pm25", round_half_up("pm25", 4)))


def _split_readings(spark, sf_dir):
    from .sources.binding import ts_lit
    from .sources.grid import grid_readings

    r = grid_readings(spark, sf_dir)
    return r.filter(F.col("fetched_at") < ts_lit(SPLIT_AT)), r.filter(F.col("fetched_at") >= ts_lit(SPLIT_AT))


@register("keyed_merge")
def q_keyed_merge(spark, sf_dir):
    """Grid table as of the split, upserted with the later batch (later reading wins)."""
    from .operators.merge import keyed_merge, latest_version

    old, new = _split_readings(spark, sf_dir)
    existing = latest_version(old, ["grid_point_id", "observed_at"], ["fetched_at", "reading_id"])
    merged = keyed_merge(existing, new.withColumn("_seq", F.col("reading_id")), ["grid_point_id", "observed_at"])
    return canon(merged.withColumn("pm25", round_half_up("pm25", 4)).withColumn("pm10", round_half_up("pm10", 4)))


@register("insert_ignore")
def q_insert_ignore(spark, sf_dir):
    """Rows of the later batch whose key is new (first reading per key wins)."""
    from .operators.merge import insert_ignore_ordered, latest_version

    old, new = _split_readings(spark, sf_dir)
    existing = latest_version(old, ["grid_point_id", "observed_at"], ["fetched_at", "reading_id"])
    ins = insert_ignore_ordered(existing, new, ["grid_point_id", "observed_at"], ["reading_id"])
    return canon(ins.withColumn("pm25", round_half_up("pm25", 4)).withColumn("pm10", round_half_up("pm10", 4)))


@register("quality_filter")
def q_quality_filter(spark, sf_dir):
    from .operators.quality import quality_report

    b = Bound(spark, sf_dir)
    return canon(quality_report(b.aq, "air_quality").unionByName(quality_report(b.wx, "weather")))


@register("quality_rejects")
def q_quality_rejects(spark, sf_dir):
    """The rows that break a range rule, one row per broken rule."""
    from .operators.quality import rule_violations

    b = Bound(spark, sf_dir)
    return canon(rule_violations(b.aq, "air_quality").unionByName(rule_violations(b.wx, "weather")))


# --- lineage views (L2, L4, L7, L8) -------------------------------------------------
@register("ingest_run_overview")
def q_ingest_run_overview(spark, sf_dir):
    from .plans.lineage import pipeline_run_overview

    return canon(pipeline_run_overview(Bound(spark, sf_dir).aq))


@register("cascade_delete")
def q_cascade_delete(spark, sf_dir):
    """Runs that started over 7 days ago are deleted, their requests with them."""
    from .operators.merge import cascade_delete
    from .sources import lineage as LT
    from .sources.binding import ts_lit

    landed = LT.payloads(Bound(spark, sf_dir).aq)
    kept = LT.pipeline_runs(landed).where(F.col("started_at") > ts_lit(AS_OF - timedelta(days=7)))
    left = cascade_delete(LT.outbound_requests(landed), kept, "pipeline_run_id", "pipeline_run_id")
    return canon(left.select("request_id", "pipeline_run_id", "status", "latency_ms", "records"))


@register("lineage_observation")
def q_lineage_observation(spark, sf_dir):
    from .plans.lineage import observation_full_lineage

    b = Bound(spark, sf_dir)
    return canon(observation_full_lineage(b.aq, b.stations))


@register("bindings_overview")
def q_bindings_overview(spark, sf_dir):
    from .plans.lineage import station_bindings_overview

    b = Bound(spark, sf_dir)
    return canon(station_bindings_overview(b.aq, b.stations, AS_OF))


@register("provider_health")
def q_provider_health(spark, sf_dir):
    from .plans.lineage import provider_health

    return canon(provider_health(Bound(spark, sf_dir).aq, AS_OF))


# --- API read queries (M1, M2, M10, M15) -----------------------------------------------
@register("api_daily_summaries")
def q_api_daily_summaries(spark, sf_dir):
    from .plans.api import daily_summaries, first_day
    from .plans.daily_summary import daily_summary

    b = Bound(spark, sf_dir)
    ds = daily_summary(b.aq, b.wx, b.stations, start=first_day(AS_OF, 30), end=(AS_OF - timedelta(days=1)).date())
    return canon(daily_summaries(ds, b.stations, AS_OF, days=30))


@register("api_anomalies")
def q_api_anomalies(spark, sf_dir):
    from .plans.anomaly import detect_anomalies
    from .plans.api import anomalies

    b = Bound(spark, sf_dir)
    found = detect_anomalies(b.aq, b.stations, AS_OF, scan_hours=SCAN_HOURS).drop("description")
    return canon(_round_value(anomalies(found, b.stations, AS_OF, days=7, severity="warning")))


@register("api_health_all")
def q_api_health_all(spark, sf_dir):
    from .plans.api import health_all

    b = Bound(spark, sf_dir)
    h = _health(spark, sf_dir).drop("time_in_levels", "pollutant_averages")
    return canon(health_all(h, b.stations))


@register("station_lineage")
def q_station_lineage(spark, sf_dir):
    from .plans.api import station_lineage
    from .plans.daily_summary import daily_summary
    from .plans.views import station_source_latest

    b = Bound(spark, sf_dir)
    ds = daily_summary(b.aq, b.wx, b.stations, end=(AS_OF - timedelta(days=1)).date())
    return canon(station_lineage(station_source_latest(b.aq, b.stations, AS_OF), ds, _fc(spark, sf_dir, "linear")))


# --- streaming (O1-O3) ------------------------------------------------------------------
@register("stream_grid_ingest")
def q_stream_grid_ingest(spark, sf_dir):
    """O1: the grid table built by the streaming upsert equals the batch dedupe."""
    from .streaming.jobs import stream_grid_ingest

    df = stream_grid_ingest(spark, sf_dir).drop("obs_date")
    return canon(df.withColumn("pm25", round_half_up("pm25", 4)).withColumn("pm10", round_half_up("pm10", 4)))


@register("stream_hourly")
def q_stream_hourly(spark, sf_dir):
    from .streaming.jobs import stream_hourly

    df = stream_hourly(spark, sf_dir)
    return canon(df.drop("obs_date").withColumn("aqi_avg", round_half_up("aqi_avg", 4)))


@register("stream_hourly_windows")
def q_stream_hourly_windows(spark, sf_dir):
    """The hours and their totals; status and late counts depend on how the files arrive."""
    from .streaming.jobs import stream_hourly_windows

    df = stream_hourly_windows(spark, sf_dir)
    return canon(df.select("station_id", "hour", round_half_up("aqi_avg", 4).alias("aqi_avg"), "samples"))


@register("stream_anomalies")
def q_stream_anomalies(spark, sf_dir):
    from .streaming.jobs import stream_anomalies

    return canon(_round_value(stream_anomalies(spark, sf_dir, AS_OF, scan_hours=SCAN_HOURS).drop("description")))


@register("stream_anomalies_rescanned")
def q_stream_anomalies_rescanned(spark, sf_dir):
    """O2: two scans of one state; the second is suppressed against the first."""
    from .streaming.jobs import ingest_anomaly_state, scan_anomalies, stream_root

    root, stations = stream_root(spark, "anomalies"), Bound(spark, sf_dir).stations
    ingest_anomaly_state(spark, sf_dir, root)
    scan_anomalies(spark, root, stations, AS_OF - timedelta(hours=12), SCAN_HOURS)
    return canon(_round_value(scan_anomalies(spark, root, stations, AS_OF, SCAN_HOURS).drop("description")))

    t = stream_anomalies(spark, sf_dir, AS_OF, scan_hours=SCAN_HOURS)
    return canon(_round_value(read_anomalies(spark, t, AS_OF, sf_dir).drop("description", "_epoch")))


# --- model lineage (L9, M13, M14) -------------------------------------------------------
def _model_tables(spark, sf_dir):
    from .plans.model_lineage import model_tables

    pts = _fc(spark, sf_dir, "linear").unionByName(_fc(spark, sf_dir, "arima")).unionByName(_fc(spark, sf_dir, "prophet"))
    return model_tables(pts, AS_OF)


@register("model_versions")
def q_model_versions(spark, sf_dir):
    from .plans.model_lineage import model_versions_listing

    return canon(model_versions_listing(_model_tables(spark, sf_dir)))


@register("predictions_list")
def q_predictions_list(spark, sf_dir):
    from .plans.model_lineage import predictions_listing

    return canon(predictions_listing(_model_tables(spark, sf_dir), Bound(spark, sf_dir).stations))


@register("model_production_status")
def q_model_production_status(spark, sf_dir):
    from .plans.model_lineage import model_production_status

    return canon(model_production_status(_model_tables(spark, sf_dir), Bound(spark, sf_dir).stations))


# --- I8 / M17: run every analytic job, report processed counts ---------------------------
@register("run_all")
def q_run_all(spark, sf_dir):
    """I8: the nine jobs on one shared binding; count of stations (or rows) each produced, as
    the job endpoints report."""
    b = Bound(spark, sf_dir)
    from .plans.anomaly import detect_anomalies
    from .plans.correlation import correlation_matrix
    from .plans.daily_summary import daily_summary
    from .plans.health import health_impact
    from .plans.seasonal import seasonal_summary
    from .plans.trend import trend_analysis

    def n_rows(name, df):
        return df.agg(F.count(F.lit(1)).alias("processed")).select(F.lit(name).alias("job"), "processed")

    def n_stations(name, df):
        return df.agg(F.countDistinct("station_id").alias("processed")).select(F.lit(name).alias("job"), "processed")

    parts = [
        n_rows("daily_summary", daily_summary(b.aq, b.wx, b.stations, end=(AS_OF - timedelta(days=1)).date())),
        n_rows("anomalies", detect_anomalies(b.aq, b.stations, AS_OF, scan_hours=SCAN_HOURS)),
        n_stations("seasonal", seasonal_summary(b.aq, b.stations, AS_OF, "aqi")),
        n_stations("correlation", correlation_matrix(b.aq, b.wx, b.stations, AS_OF)),
        n_stations("trend", trend_analysis(b.aq, b.stations, AS_OF)),
        n_stations("health", health_impact(b.aq, b.stations, AS_OF)),
        *[n_stations(f"forecast_{m}", _fc(spark, sf_dir, m).filter(F.col("status") == "success")) for m in ("linear", "arima", "prophet")],
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return canon(out)


# --- M6-M9: latest analysis per station over an analysis history --------------------------
HISTORY = [AS_OF - timedelta(days=7), AS_OF]


def _history(job):
    from functools import reduce

    parts = [job(t).withColumn("analysis_date", F.lit(t.date().isoformat()).cast("date")) for t in HISTORY]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("api_latest_trend")
def q_api_latest_trend(spark, sf_dir):
    """M8: latest trend row per (station, metric) across analysis dates."""
    from .plans.api import latest_run
    from .plans.trend import trend_analysis

    b = Bound(spark, sf_dir)
    hist = _history(lambda t: trend_analysis(b.aq, b.stations, t))
    return canon(latest_run(hist, ["station_id", "metric"], "analysis_date"))


@register("api_latest_health")
def q_api_latest_health(spark, sf_dir):
    """M9: latest health assessment per station across analysis dates."""
    from .plans.api import latest_run
    from .plans.health import health_impact

    b = Bound(spark, sf_dir)
    hist = _history(lambda t: health_impact(b.aq, b.stations, t).drop("time_in_levels", "pollutant_averages"))
    return canon(latest_run(hist, ["station_id"], "analysis_date"))


@register("analysis_lineage")
def q_analysis_lineage(spark, sf_dir):
    """L6 over the daily-summary runs and the 24 h anomaly scan."""
    from .plans.anomaly import detect_anomalies
    from .plans.daily_summary import daily_summary
    from .plans.lineage import analysis_run_lineage

    b = Bound(spark, sf_dir)
    ds = daily_summary(b.aq, b.wx, b.stations, end=(AS_OF - timedelta(days=1)).date())
    an = detect_anomalies(b.aq, b.stations, AS_OF, scan_hours=SCAN_HOURS)
    return canon(analysis_run_lineage(b.aq, b.stations, ds, an))


@register("lineage_prediction")
def q_lineage_prediction(spark, sf_dir):
    from .plans.model_lineage import prediction_full_lineage

    return canon(prediction_full_lineage(_model_tables(spark, sf_dir), Bound(spark, sf_dir).stations))


@register("top_provinces")
def q_top_provinces(spark, sf_dir):
    """provinces with the most observed grid points (top 10) after seeding (K3)."""
    from .plans.api import top_k_frequency

    return canon(top_k_frequency(q_grid_provinces(spark, sf_dir), "province_name", 10))


@register("api_latest_seasonal")
def q_api_latest_seasonal(spark, sf_dir):
    """M6: latest seasonal summary per station across analysis dates (camelCase API columns)."""
    from .plans.api import camel_case, latest_run
    from .plans.seasonal import seasonal_summary

    b = Bound(spark, sf_dir)

    def job(t):
        s = seasonal_summary(b.aq, b.stations, t, "aqi")
        return s.select(
            "station_id", "metric",
            F.array_join(F.transform("peak_hours", lambda h: h.cast("string")), ",").alias("peak_hours"),
            F.array_join(F.transform("off_peak_hours", lambda h: h.cast("string")), ",").alias("off_peak_hours"),
            "best_dow", "worst_dow", "overall_avg", "hourly_variation")

    return camel_case(canon(latest_run(_history(job), ["station_id"], "analysis_date")))


@register("api_latest_correlation")
def q_api_latest_correlation(spark, sf_dir):
    """M7: latest correlation matrix per station (pairs as rows) across analysis dates."""
    from .plans.correlation import correlation_matrix

    b = Bound(spark, sf_dir)
    from pyspark.sql import Window

    hist = _history(lambda t: correlation_matrix(b.aq, b.wx, b.stations, t))
    # <= 42 pairs x dates per station: a bounded window, and the history is referenced once
    last = F.max("analysis_date").over(Window.partitionBy("station_id"))
    return canon(hist.withColumn("_last", last).filter(F.col("analysis_date") == F.col("_last")).drop("_last"))


@register("api_latest_forecast")
def q_api_latest_forecast(spark, sf_dir):
    """M3: latest successful linear forecast per station, points flattened to rows."""
    from .plans.api import latest_forecast

    lf = latest_forecast(_fc(spark, sf_dir, "linear"))
    return canon(lf.select("station_id", "run_id", "mae", F.explode("points").alias("p")).select(
        "station_id", "run_id", "mae", "p.step", "p.predicted_at", "p.predicted_value", "p.lower_bound", "p.upper_bound"))


@register("api_forecast_runs")
def q_api_forecast_runs(spark, sf_dir):
    """M5: forecast runs list (all models), newest first, limit 100."""
    from .plans.api import forecast_runs_list
    from .plans.forecast import forecast_runs

    pts = _fc(spark, sf_dir, "linear").unionByName(_fc(spark, sf_dir, "arima")).unionByName(_fc(spark, sf_dir, "prophet"))
    return canon(forecast_runs_list(forecast_runs(pts), limit=100))


@register("forecast_run_gates")
def q_forecast_run_gates(spark, sf_dir):
    """J6 structure without model values: which stations each model ran for, with how many
    hourly training points, its status and the number of forecast points."""
    from .plans.forecast import forecast_runs

    pts = _fc(spark, sf_dir, "linear").unionByName(_fc(spark, sf_dir, "arima")).unionByName(_fc(spark, sf_dir, "prophet"))
    return canon(forecast_runs(pts).select("station_id", "model_type", "horizon_hours", "training_rows", "status", "n_points"))


@register("stream_anomalies_stateful")
def q_stream_anomalies_stateful(spark, sf_dir):
    """O2 with keyed streaming state (applyInPandasWithState); in-batch suppression (T5)."""
    from .streaming.jobs import stream_anomalies_stateful

    return canon(_round_value(stream_anomalies_stateful(spark, sf_dir, AS_OF, scan_hours=SCAN_HOURS)))


@register("grid_seed_upsert")
def q_grid_seed_upsert(spark, sf_dir):
    """K3: the grid-point table after upserting the seeded provinces by (lat, lng)."""
    from .plans.grid import seed_grid_points
    from .sources.grid import lattice

    return canon(seed_grid_points(lattice(spark), q_grid_provinces(spark, sf_dir)))
