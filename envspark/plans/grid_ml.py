"""Grid ML: feature frames (J8, J9), gradient-boosted regressor with station-grouped
k-fold CV (J10, J11), champion/challenger promotion (J12), grid prediction (J13)
and model listing (J14).

Neighbour features come from ``knn_join`` (multi-resolution cell probes), never
from an all-pairs self-join.  The regressor is ``operators.boosting``: missing
features are routed by gain, and the models of all folds and the final one grow together.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (
    GBT_PARAMS, ML_INFERENCE_MAX_AGE_HOURS, ML_KNN, ML_MIN_ROWS, ML_PROMOTE_RATIO, ML_SOURCE, ML_TRAINING_DAYS,
)
from ..functions import confidence_from_mae, hour_cos, hour_sin
from ..functions.timefn import dow_mon0
from ..operators import latest_per_key
from ..operators.boosting import Boosted, Settings, fit
from ..operators.dimension import attach
from ..operators.positional import positional_index
from ..operators.spatial import knn_join
from ..session import cut_lineage
from ..sources.binding import ts_lit
from .common import active_only, window

WEATHER_FEATURES = ["temperature_c", "humidity_pct", "wind_speed_mps", "pressure_hpa", "precipitation_mm", "cloud_cover_pct"]
FEATURE_COLUMNS = ["lat", "lng", "hour_sin", "hour_cos", "dow", "month", *WEATHER_FEATURES,
                   "neighbor_aqi_mean", "neighbor_dist_mean", "neighbor_count"]

STATION_CELL_DEG = None  # first probe cell from the data density (auto); doubles per round


def _neighbours(left: DataFrame, right: DataFrame, keys: list[str], exclude_self: bool) -> DataFrame:
    nn = knn_join(left, right, ML_KNN, left_id="id", right_id="id", partition_keys=keys, exclude_self=exclude_self,
                  cell_deg=STATION_CELL_DEG)
    return nn.groupBy(*keys, "id").agg(
        F.avg("r_aqi").alias("neighbor_aqi_mean"), F.avg("dist_km").alias("neighbor_dist_mean"),
        F.count(F.lit(1)).cast("double").alias("neighbor_count"),
    )


def training_frame(aq: DataFrame, wx: DataFrame, stations: DataFrame, as_of: datetime, days: int = ML_TRAINING_DAYS) -> DataFrame:
    """One row per (active station, hour) with the target ``aqi`` and 15 features."""
    st = stations.filter("is_active").select("station_id", "lat", "lng")
    a = active_only(window(aq, as_of, days=days), stations).filter(F.col("aqi").isNotNull())
    ah = a.groupBy("station_id", F.date_trunc("hour", "observed_at").alias("ts")).agg(F.avg(F.col("aqi").cast("double")).alias("aqi"))
    ah = ah.join(st, "station_id")
    wh = window(wx, as_of, days=days).groupBy("station_id", F.date_trunc("hour", "observed_at").alias("ts")).agg(
        *[F.avg(c).alias(c) for c in WEATHER_FEATURES])
    # the hourly station table feeds both kNN sides and the final join: written once, nothing to release
    ah = cut_lineage(ah)
    pts = ah.select(F.col("station_id").alias("id"), "ts", "lat", "lng", "aqi")
    nb = _neighbours(pts.drop("aqi"), pts, ["ts"], exclude_self=True)
    df = ah.join(wh, ["station_id", "ts"], "left").join(nb.withColumnRenamed("id", "station_id"), ["station_id", "ts"], "left")
    return df.select(
        "station_id", "ts", "lat", "lng", hour_sin(F.col("ts")).alias("hour_sin"), hour_cos(F.col("ts")).alias("hour_cos"),
        dow_mon0(F.col("ts")).cast("double").alias("dow"), F.month("ts").cast("double").alias("month"),
        *WEATHER_FEATURES, "neighbor_aqi_mean", "neighbor_dist_mean",
        F.coalesce("neighbor_count", F.lit(0.0)).alias("neighbor_count"), "aqi",
    )


def inference_frame(aq: DataFrame, wx: DataFrame, stations: DataFrame, points: DataFrame, as_of: datetime) -> DataFrame:
    """Features for every active land grid point at ``as_of``: 3 nearest fresh stations
    (latest AQI < 6 h) and the nearest station with fresh weather."""
    st = stations.select("station_id", "lat", "lng", "is_active")
    a = window(aq, as_of, hours=ML_INFERENCE_MAX_AGE_HOURS).filter(F.col("aqi").isNotNull())
    a = active_only(a, stations)
    sa = latest_per_key(a, ["station_id"], ["observed_at", "obs_id"], ["aqi"]).join(st, "station_id")
    sw = latest_per_key(window(wx, as_of, hours=ML_INFERENCE_MAX_AGE_HOURS), ["station_id"], ["observed_at", "obs_id"],
                        WEATHER_FEATURES).join(st, "station_id")
    g = points.filter("is_active AND is_land").select(F.col("grid_point_id").alias("id"), "lat", "lng")
    nb = _neighbours(g, sa.select(F.col("station_id").alias("id"), "lat", "lng", F.col("aqi").cast("double").alias("aqi")), [], False)
    nw = knn_join(g, sw.select(F.col("station_id").alias("id"), "lat", "lng", *WEATHER_FEATURES), 1,
                  left_id="id", right_id="id", cell_deg=STATION_CELL_DEG).select("id", *[F.col(f"r_{c}").alias(c) for c in WEATHER_FEATURES])
    t = ts_lit(as_of)
    df = g.join(nb, "id", "left").join(nw, "id", "left")
    return df.select(
        F.col("id").alias("grid_point_id"), "lat", "lng", hour_sin(t).alias("hour_sin"), hour_cos(t).alias("hour_cos"),
        dow_mon0(t).cast("double").alias("dow"), F.month(t).cast("double").alias("month"), *WEATHER_FEATURES,
        "neighbor_aqi_mean", "neighbor_dist_mean", F.coalesce("neighbor_count", F.lit(0.0)).alias("neighbor_count"),
    )


# ----------------------------------------------------------------------------- model
def lightest_folds(sizes: list[tuple[int, int]], k: int) -> dict[int, tuple[list[int], list[int]]]:
    """For groups given as (size, number of groups of that size): the folds of the groups of each size, in their
    order, when groups go by falling size to the lightest fold (the first among equals), as a beginning and
    a cycle that repeats.  Once all folds lie less than one size apart, they take turns."""
    load, out = [0] * k, {}
    for size, number in sorted(sizes, reverse=True):
        begin = []
        while len(begin) < number and max(load) - min(load) >= size:
            f = load.index(min(load))
            begin.append(f)
            load[f] += size
        turn = sorted(range(k), key=lambda f: (load[f], f))
        rest = number - len(begin)
        # a fold of equal load comes first in its turn, so one full turn adds one group to each
        for f in turn:
            load[f] += size * (rest // k)
        for f in turn[: rest % k]:
            load[f] += size
        out[size] = (begin, turn)
    return out


def station_folds(train: DataFrame, k_max: int = 5) -> tuple[DataFrame, DataFrame]:
    """Fold per station, k = min(5, #stations): the largest group to the lightest fold, stations of one
    size in the order of their ids.  Only the histogram of sizes (hours of the training days at most) reaches the driver."""
    sizes = train.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    held = [(r["n"], r["c"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()]
    k = max(1, min(k_max, sum(c for _, c in held)))
    plan = lightest_folds(held, k)
    ranked = positional_index(sizes, ["n"], ["station_id"], out="_r")
    rows = [(n, begin, turn) for n, (begin, turn) in plan.items()]
    table = train.sparkSession.createDataFrame(rows, "n long, _begin array<int>, _turn array<int>")
    r, past = F.col("_r").cast("int"), F.col("_r") - F.size("_begin")
    fold = F.when(past < 0, F.get(F.col("_begin"), r)).otherwise(F.get(F.col("_turn"), F.pmod(past, F.lit(k)).cast("int")))
    folds = attach(ranked, table, "n", "inner").select("station_id", fold.cast("int").alias("fold"), F.lit(k).alias("k"))
    return attach(train, folds, "station_id", "inner"), folds


def train_and_evaluate(train: DataFrame, params: dict | None = None):
    """Returns (model fitted on all rows, metrics DataFrame)."""
    p = dict(GBT_PARAMS if params is None else params)
    settings = Settings(p["maxIter"], p["stepSize"], p["maxDepth"], p["minInstancesPerNode"], p["maxBins"] - 1)
    withf, folds = station_folds(train)
    k = folds.first()
    k = k["k"] if k is not None and k["k"] >= 2 else 0
    # fewer than two stations: nothing is held out
    model, errors, n_rows = fit(withf, ["station_id", "ts"], FEATURE_COLUMNS, "aqi", "fold", k, settings)
    if k:
        parts = [errors[f] for f in range(k)]
        kind = f"group_kfold_{k}"
    else:
        parts, kind = [errors[-1]], "in_sample_single_group"
    mae = sum(a / n for n, a, _ in parts) / len(parts)
    rmse = sum((q / n) ** 0.5 for n, _, q in parts) / len(parts)
    metrics = train.sparkSession.createDataFrame(
        [(kind, max(k, 1), n_rows, round(float(mae), 3), round(float(rmse), 3))],
        "cv_kind string, folds int, sample_count long, mae double, rmse double",
    )
    return model, metrics


def promote(challenger: DataFrame, champion: DataFrame | None) -> DataFrame:
    """Promote when there is no champion or challenger MAE <= champion MAE x 0.95."""
    if champion is None:
        return challenger.withColumn("promoted", F.lit(True)).withColumn("champion_mae_before", F.lit(None).cast("double"))
    # the champion metadata is a single row: read its MAE as a scalar subquery
    j = challenger.withColumn("champion_mae_before", champion.agg(F.max("mae")).scalar())
    return j.withColumn("promoted", F.col("champion_mae_before").isNull() |
                        (F.col("mae") <= F.col("champion_mae_before") * ML_PROMOTE_RATIO))


def run_grid_training(aq, wx, stations, as_of, params=None, model_dir: str | None = None, champion=None):
    """Returns (model, metadata DataFrame); saves the model when promoted and ``model_dir`` given.  The gate on
    rows comes before any fit.  ``champion``: metadata of the model in use (``champion_meta``), or None."""
    train = cut_lineage(training_frame(aq, wx, stations, as_of))
    if train.count() < ML_MIN_ROWS:
        raise ValueError("insufficient data for training")
    model, metrics = train_and_evaluate(train, params)
    meta = promote(metrics.withColumn("trained_at", ts_lit(as_of)), champion)
    if model_dir and meta.first()["promoted"]:
        model.save(train.sparkSession, f"{model_dir}/champion")
        cut_lineage(meta).write.mode("overwrite").parquet(f"{model_dir}/champion_meta")
    return model, meta


def champion_meta(spark, model_dir: str) -> DataFrame:
    """Metadata of the champion stored under ``model_dir``."""
    return spark.read.parquet(f"{model_dir}/champion_meta")


def load_champion(spark, model_dir: str):
    """(model, CV MAE) of the champion stored under ``model_dir``."""
    return Boosted.load(spark, f"{model_dir}/champion"), champion_meta(spark, model_dir).first()["mae"]


def predict_grid(model, features: DataFrame, as_of: datetime, champion_mae: float | None) -> DataFrame:
    """Rows for the grid observation table (upsert by (grid_point_id, observed_at))."""
    pred = model.transform(features)
    conf = confidence_from_mae(F.lit(champion_mae).cast("double"))
    return pred.select(
        "grid_point_id", F.date_trunc("hour", ts_lit(as_of)).alias("observed_at"),
        F.greatest(F.lit(0), F.bround("prediction", 0).cast("int")).alias("aqi"),
        F.lit(ML_SOURCE).alias("source_code"), conf.alias("confidence_score"),
    )
