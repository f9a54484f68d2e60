"""Linear forecast (J1-J3) from sums of products.

The feature rows of the hourly series (at most 24 x training-days a station) become one matrix of sums of products for
each part of a station's series, the early part that the backtest learns from and the rest.  numpy sees one row a
station and part: it adds the parts, solves both fits and feeds the forecast back into its features.  Predictions of
known hours, their errors and the interval are column expressions.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EVAL_MIN_POINTS, LINEAR_HORIZON_HOURS, LINEAR_MIN_POINTS, TRAIN_FRACTION
from ..functions.timefn import epoch_seconds

FEATURES = ["hour", "day_of_week", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
            "rolling_mean_6h", "rolling_std_6h", "rolling_mean_24h", "lag_1h", "lag_24h"]
#: Features in the unit and level of the series itself.
LEVELS = ["rolling_mean_6h", "rolling_mean_24h", "lag_1h", "lag_24h"]
TERMS = ["one", *FEATURES, "y"]
#: Directions of the scaled features with less than this share of the largest spread count as collinear.
COLLINEAR = 1e-11

MODEL_SCHEMA = ("station_id int, training_rows long, last_hour long, early array<double>, coefficients array<double>, "
                "tail array<double>, error_message string")


def calendar(hours: np.ndarray) -> np.ndarray:
    """Hour, weekday (Monday 0) and their sine / cosine pairs, for hours since the epoch (a Thursday)."""
    parts = np.stack([hours % 24, (hours // 24 + 3) % 7], 1)
    angle = 2 * np.pi * parts / np.array([24.0, 7.0])
    waves = np.stack([np.sin(angle), np.cos(angle)], 2).reshape(len(parts), 4)
    return np.concatenate([parts, waves], 1)


def feed_back(beta: np.ndarray, tail: list[float], hours: np.ndarray) -> list[float]:
    """Values of the next ``hours``; each joins the last 24 that the next one's features are made of."""
    recent = deque(tail, maxlen=24)
    values = []
    for waves in calendar(hours):
        day = np.array(recent)
        six = day[-6:]
        trail = [six.mean(), six.std() if len(day) >= 6 else 0.0, day.mean(), day[-1], day[0] if len(day) == 24 else day[-1]]
        recent.append(max(0.0, float(beta @ np.concatenate([[1.0], waves, trail]))))
        values.append(recent[-1])
    return values


def solve(products: np.ndarray, level: float) -> np.ndarray:
    """Intercept and coefficients of least squares from the matrix of sums of products over TERMS, whose level
    columns were reduced by ``level``.  Collinear features share the solution of least norm in units of their spread."""
    n, sums = products[0, 0], products[0, 1:]
    centred = products[1:, 1:] - np.outer(sums, sums) / n
    spread = np.sqrt(np.maximum(np.diag(centred)[:-1], 0))
    spread = np.where(spread > 1e-9 * np.sqrt(np.maximum(np.diag(products)[1:-1], 1e-300)), spread, np.inf)
    scaled = centred[:-1, :-1] / np.outer(spread, spread)
    size, axes = np.linalg.eigh(scaled)
    keep = size > COLLINEAR * max(size[-1], 1e-300)
    beta = axes[:, keep] @ ((axes[:, keep].T @ (centred[:-1, -1] / spread)) / size[keep]) / spread
    of_level = sum(beta[FEATURES.index(name)] for name in LEVELS)
    return np.concatenate([[(sums[-1] - sums[:-1] @ beta) / n + level - level * of_level], beta])


def _solve_station(parts: pd.DataFrame) -> pd.DataFrame:
    """Both fits of one station, from the sums of its early part and of the rest (one row each)."""
    first = parts.iloc[0]
    station, rows = int(first.station_id), int(first.n)
    tail = [v["y"] for v in sorted((v for t in parts["tail"] for v in t), key=lambda v: v["pos"])]
    out = dict(station_id=station, training_rows=rows, last_hour=int(first.last_hour), early=None, coefficients=None, tail=tail, error_message=None)
    upper = np.triu_indices(len(TERMS))
    try:
        matrices = {}
        for part in parts.itertuples():
            half = np.zeros((len(TERMS), len(TERMS)))
            half[upper] = part.products
            matrices[bool(part.is_early)] = half + np.triu(half, 1).T
        out["coefficients"] = solve(sum(matrices.values()), first.level).tolist()
        if rows - int(rows * TRAIN_FRACTION) >= EVAL_MIN_POINTS:
            out["early"] = solve(matrices[True], first.level).tolist()
    except Exception as e:  # noqa: BLE001 — one station's failure must not stop the others
        out |= dict(early=None, coefficients=None, error_message=str(e)[:500])
    return pd.DataFrame([out])


def numbered_features(features: DataFrame) -> DataFrame:
    """Feature rows of stations with enough hours, numbered in time; ``is_early`` marks the part for the backtest."""
    whole = Window.partitionBy("station_id")
    rows = features.select("*", F.row_number().over(whole.orderBy("ts")).alias("pos"), F.count(F.lit(1)).over(whole).alias("n"),
                           F.avg("y").over(whole).alias("level"))
    return rows.where(F.col("n") >= LINEAR_MIN_POINTS).withColumn("is_early", F.col("pos") <= F.floor(F.col("n") * TRAIN_FRACTION))


def fit(rows: DataFrame) -> DataFrame:
    """One row a station: coefficients of the early part and of all rows, the last 24 values."""
    def term(name: str) -> Column:
        value = F.lit(1.0) if name == "one" else F.col(name).cast("double")
        return value - F.col("level") if name in LEVELS or name == "y" else value

    products = [F.sum(term(a) * term(b)) for i, a in enumerate(TERMS) for b in TERMS[i:]]
    last = F.when(F.col("pos") > F.col("n") - 24, F.struct("pos", "y"))
    sums = rows.groupBy("station_id", "n", "level", "is_early").agg(
        F.array(*products).alias("products"), F.collect_list(last).alias("tail"), F.max(epoch_seconds(F.col("ts")) / 3600).cast("long").alias("hour"))
    whole = Window.partitionBy("station_id")
    return sums.withColumn("last_hour", F.max("hour").over(whole)).groupBy("station_id").applyInPandas(_solve_station, MODEL_SCHEMA)


def _predicted(coefficients: str) -> Column:
    value = F.col(coefficients)[0]
    for i, name in enumerate(FEATURES, 1):
        value = value + F.col(coefficients)[i] * F.col(name)
    return value


def errors(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Errors of the backtest (to 3 places; zeros left out of MAPE) and the spread of the whole fit's residuals."""
    known = rows.join(model.select("station_id", "early", "coefficients"), "station_id")
    error = F.when(~F.col("is_early"), F.col("y") - _predicted("early"))
    return known.groupBy("station_id").agg(
        F.bround(F.avg(F.abs(error)), 3).alias("mae"), F.bround(F.sqrt(F.avg(error * error)), 3).alias("rmse"),
        F.bround(100 * F.avg(F.when(F.col("y") != 0, F.abs(error / F.col("y")))), 3).alias("mape"),
        F.stddev_pop(F.col("y") - _predicted("coefficients")).alias("spread"))


def _forecast(models: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    steps = np.arange(1, LINEAR_HORIZON_HOURS + 1)
    for batch in models:
        values = [np.array(feed_back(m.coefficients, list(m.tail), m.last_hour + steps)) for m in batch.itertuples()]
        yield pd.DataFrame({"station_id": batch.station_id, "steps": [steps] * len(batch), "values": values})


def linear_points(features: DataFrame, metric: str) -> DataFrame:
    """Forecast points of every station with their run columns; a station whose fit failed has one row."""
    rows = numbered_features(features)
    model = fit(rows)
    values = model.where("error_message IS NULL").select("station_id", "coefficients", "tail", "last_hour").mapInPandas(
        _forecast, "station_id int, steps array<int>, values array<double>")
    points = values.select("station_id", F.explode(F.arrays_zip("steps", "values")).alias("p")).select(
        "station_id", F.col("p.steps").alias("step"), F.col("p.values").alias("value"))
    runs = model.select("station_id", "training_rows", "last_hour", "error_message").join(errors(rows, model), "station_id")
    half = 1.96 * F.col("spread") * (1 + 0.05 * (F.col("step") - 1))
    hour = F.to_timestamp_ntz(F.from_unixtime((F.col("last_hour") + F.col("step")) * 3600))
    return runs.join(points, "station_id", "left").select(
        "station_id", F.lit("linear").alias("model_type"), F.lit(metric).alias("target_metric"), F.lit(LINEAR_HORIZON_HOURS).alias("horizon_hours"),
        "training_rows", F.when(F.col("error_message").isNull(), "success").otherwise("failed").alias("status"), "error_message",
        "mae", "rmse", "mape", "step", F.bround("value", 2).alias("predicted_value"),
        F.bround(F.greatest(F.col("value") - half, F.lit(0.0)), 2).alias("lower_bound"), F.bround(F.col("value") + half, 2).alias("upper_bound"),
        hour.alias("predicted_at"))


def linear_model(features: DataFrame) -> DataFrame:
    """The fitted models themselves: errors, residual spread and one column a coefficient."""
    rows = numbered_features(features)
    model = fit(rows)
    named = [F.col("coefficients")[i].alias(name) for i, name in enumerate(["intercept", *FEATURES])]
    return model.join(errors(rows, model), "station_id").select("station_id", "training_rows", "mae", "rmse", "mape", "spread", *named)
