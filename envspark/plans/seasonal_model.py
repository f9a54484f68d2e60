"""Additive seasonal forecast on raw rows (piecewise-linear trend, daily and weekly waves).

The model is the most probable one under a normal prior on offset, slope and waves, a Laplace prior on the
changes of slope and a half-normal prior on the noise.  It needs nothing but sums of products of its columns,
so raw rows are never gathered: rows are numbered by time (``positional_index``), the number tells the segment
between two changepoints, and each (station, part, segment) keeps the products of (1, time, waves, value).
A changepoint column is linear in time inside a segment, so the sums of all columns follow from these.  A station
sends at most 2 x 26 segments of 153 sums to its fit, however many rows it has.

Part ``full`` holds all rows and gives the forecast; part ``train`` the first 80 %, whose model is compared
with the other rows: the i-th of them with the value i hours after the last row of the part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    EVAL_MIN_POINTS, METRICS, SEASONAL_FC_HORIZON_HOURS, SEASONAL_FC_MIN_POINTS, SEASONAL_FC_TRAIN_DAYS, TRAIN_FRACTION,
)
from ..operators.dimension import attach
from ..operators.positional import positional_index
from ..session import cut_lineage
from ..sources.binding import ts_lit
from .common import active_only, window
from .evaluation import evaluate

DAY = 86400.0
#: Waves: (period in days, number of sine and cosine pairs).
WAVES = ((1.0, 4), (7.0, 3))
CHANGEPOINTS = 25
CHANGE_RANGE = 0.8  # changepoints lie in this share of the rows
CHANGE_SCALE = 0.05  # Laplace scale of a change of slope
TREND_SD, WAVE_SD, NOISE_SD = 5.0, 10.0, 0.5  # normal priors, on values divided by the largest
INTERVAL = 1.2815515655446004  # normal quantile of 90 %, for an interval of 80 %
BASE = 3 + 2 * sum(k for _, k in WAVES)  # 1, time, waves, value
UPPER = np.triu_indices(BASE)
#: Segments whose sums a task holds before it sends them on.
HELD_SEGMENTS = 4000

SUMS_SCHEMA = "station_id int, part string, segment int, first double, last double, largest double, sums array<double>"
FIT_SCHEMA = (
    "station_id int, status string, error_message string, last double, values array<double>, halves array<double>, "
    "begin double, span double, bends array<double>, beta array<double>, train_last double"
)


def waves(epoch: np.ndarray) -> np.ndarray:
    angle = np.concatenate([np.outer(epoch / DAY, 2 * np.pi * np.arange(1, k + 1) / period) for period, k in WAVES], 1)
    return np.concatenate([np.sin(angle), np.cos(angle)], 1)


def _segment(pos: Column, n: Column) -> Column:
    """Number of changepoints at or before the row ``pos`` of ``n``: they are evenly spaced by row number."""
    history = F.floor(n * F.lit(CHANGE_RANGE))
    number = F.least(F.lit(CHANGEPOINTS).cast("long"), history - 1)
    at = lambda j: F.rint(j * (history - 1) / number)
    near = F.least(F.floor(pos * number / (history - 1)), number)  # rounding may place the next one at the row
    return F.when((near + 1 <= number) & (at(near + 1) <= pos), near + 1).otherwise(near).cast("int")


def _products(epoch: np.ndarray, y: np.ndarray, origin: float, span: float) -> np.ndarray:
    columns = np.concatenate([np.ones((len(y), 1)), ((epoch - origin) / span)[:, None], waves(epoch), y[:, None]], 1)
    return columns.T @ columns


def _sums(origin: float, span: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def send() -> pd.DataFrame:
            return pd.DataFrame([(*key, *ends, products[UPPER].tolist()) for key, (ends, products) in held.items()],
                                columns=["station_id", "part", "segment", "first", "last", "largest", "sums"])

        for batch in batches:
            for key, rows in batch.groupby(["station_id", "part", "segment"], sort=False):
                epoch, y = rows["epoch"].to_numpy(), rows["y"].to_numpy()
                ends, products = held.get(key, ((math.inf, -math.inf, 0.0), np.zeros((BASE, BASE))))
                ends = min(ends[0], epoch.min()), max(ends[1], epoch.max()), max(ends[2], np.abs(y).max())
                held[key] = (ends, products + _products(epoch, y, origin, span))
            if len(held) > HELD_SEGMENTS:
                yield send()
                held.clear()
        if held:
            yield send()

    return run


class Gram:
    """Sums of products of the model's columns for one part of one station."""

    def __init__(self, segments: pd.DataFrame, origin: float, span: float):
        segments = segments.sort_values("segment")
        self.begin, self.end = float(segments["first"].min()), float(segments["last"].max())
        self.scale = float(segments["largest"].max()) or 1.0
        self.span = self.end - self.begin
        if not self.span > 0:
            raise ValueError("all rows lie at one time")
        self.bends = (segments["first"].to_numpy()[segments["segment"].to_numpy() > 0] - self.begin) / self.span
        count, offset, slope = len(self.bends), (origin - self.begin) / self.span, span / self.span
        size = 2 + count + BASE - 3
        total = np.zeros((size + 1, size + 1))
        for segment, sums in zip(segments["segment"], segments["sums"]):
            products = np.zeros((BASE, BASE))
            products[UPPER] = sums
            products = products + np.triu(products, 1).T
            to = np.zeros((BASE, size + 1))  # base columns -> columns of the model
            to[0, 0], to[0, 1], to[1, 1] = 1.0, offset, slope
            passed = 2 + np.arange(min(segment, count))
            to[0, passed], to[1, passed] = offset - self.bends[passed - 2], slope
            to[np.arange(2, BASE - 1), np.arange(2 + count, size)] = 1.0
            to[BASE - 1, size] = 1.0 / self.scale
            total += to.T @ products @ to
        self.rows, self.products, self.target, self.square = total[0, 0], total[:size, :size], total[:size, size], total[size, size]
        # precision of the normal priors, weight of the Laplace prior
        self.ridge = np.concatenate([np.full(2, TREND_SD**-2), np.zeros(count), np.full(BASE - 3, WAVE_SD**-2)])
        self.weight = np.concatenate([np.zeros(2), np.full(count, 1 / CHANGE_SCALE), np.zeros(BASE - 3)])

    def residual(self, b: np.ndarray) -> float:
        return max(self.square - 2 * b @ self.target + b @ self.products @ b, 0.0)

    def solve(self) -> tuple[np.ndarray, float]:
        """Coefficients and noise of greatest posterior density (values divided by ``scale``)."""
        b, variance = np.zeros(len(self.target)), 0.25
        for _ in range(200):
            b = lasso(self.products + variance * np.diag(self.ridge), self.target, variance * self.weight, b)
            rest = self.residual(b)
            # n log s + rest / (2 s^2) + s^2 / (2 NOISE_SD^2) is least where NOISE_SD^-2 s^4 + n s^2 = rest
            tight = NOISE_SD**-2
            new = max(2 * rest / (self.rows + math.sqrt(self.rows**2 + 4 * tight * rest)), 1e-12)
            done = abs(new - variance) <= 1e-9 * variance
            variance = new
            if done:
                break
        return b, math.sqrt(variance)


def lasso(a: np.ndarray, g: np.ndarray, weight: np.ndarray, b: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Least ``b a b / 2 - b g + sum(weight |b|)``: coordinate descent from ``b``, then exact solutions of the
    columns in use, until the conditions of a minimum hold."""
    b, diagonal, tight = b.copy(), np.diag(a), 1e-9 * (1 + np.abs(g).max())
    for _ in range(40):
        for _ in range(sweeps):
            before = b.copy()
            for i in range(len(b)):
                pull = g[i] - a[i] @ b + diagonal[i] * b[i]
                b[i] = math.copysign(max(abs(pull) - weight[i], 0.0), pull) / diagonal[i] if diagonal[i] > 0 else 0.0
            if np.abs(b - before).max() < 1e-12:
                break
        for _ in range(len(b)):  # towards the solution with these signs, as far as the signs hold
            used = np.flatnonzero((weight == 0) | (b != 0))
            aim = np.linalg.lstsq(a[np.ix_(used, used)], g[used] - weight[used] * np.sign(b[used]), rcond=None)[0]
            turned = (weight[used] > 0) & (aim * b[used] <= 0)
            if not turned.any():
                b[used] = aim
                break
            share = b[used][turned] / (b[used][turned] - aim[turned])
            b[used] += share.min() * (aim - b[used])
            b[used[np.flatnonzero(turned)[share.argmin()]]] = 0.0
        slope = g - a @ b
        off = np.where((weight == 0) | (b != 0), np.abs(slope - weight * np.sign(b)), np.maximum(np.abs(slope) - weight, 0))
        if off.max() <= tight:
            break
    return b


def predict(epoch: np.ndarray, begin: float, span: float, bends: np.ndarray, beta: np.ndarray) -> np.ndarray:
    t = (epoch - begin) / span
    bent = np.maximum(t[:, None] - bends[None], 0.0)
    return np.concatenate([np.ones((len(t), 1)), t[:, None], bent, waves(epoch)], 1) @ beta


def gram_of_series(epoch: np.ndarray, y: np.ndarray) -> Gram:
    """The same sums for one series in memory, in time order."""
    history = int(len(y) * CHANGE_RANGE)
    number = min(CHANGEPOINTS, history - 1)
    segment = np.searchsorted(np.rint(np.arange(1, number + 1) * (history - 1) / number), np.arange(len(y)), side="right")
    origin, span = float(epoch[0]), float(epoch[-1] - epoch[0]) or 1.0
    rows = []
    for k in range(number + 1):
        e, v = epoch[segment == k], y[segment == k]
        rows.append((k, e.min(), e.max(), np.abs(v).max(), _products(e, v, origin, span)[UPPER]))
    return Gram(pd.DataFrame(rows, columns=["segment", "first", "last", "largest", "sums"]), origin, span)


def _forecast(gram: Gram, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and half widths of the interval for the hours after the last row."""
    beta, noise = gram.solve()
    ahead = 3600.0 * np.arange(1, steps + 1)
    # later changes of slope come as often and as large as those found
    changes = beta[2:2 + len(gram.bends)]
    rate = 2 * len(changes) * (np.abs(changes).mean() if len(changes) else 0.0) ** 2
    spread = np.sqrt(noise**2 + rate * (ahead / gram.span) ** 3 / 3)
    values = predict(gram.end + ahead, gram.begin, gram.span, gram.bends, beta)
    return values * gram.scale, INTERVAL * spread * gram.scale


class SeasonalSeries:
    """The model of one series in memory, as the backtest of the other models takes it."""

    def __init__(self, epoch: np.ndarray, y: np.ndarray):
        self.epoch, self.y = epoch.astype(float), y

    def holdout(self, split: int) -> np.ndarray:
        return _forecast(gram_of_series(self.epoch[:split], self.y[:split]), len(self.y) - split)[0]

    def forecast(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        return _forecast(gram_of_series(self.epoch, self.y), steps)


def _fit(origin: float, span: float):
    columns = [c.strip().split(" ")[0] for c in FIT_SCHEMA.split(",")]

    def run(key: tuple, sums: pd.DataFrame) -> pd.DataFrame:
        row = dict.fromkeys(columns)
        row.update(station_id=key[0], status="success")
        try:
            segments = sums.sort_values("place").groupby(["part", "segment"], as_index=False).agg(
                first=("first", "min"), last=("last", "max"), largest=("largest", "max"), sums=("value", list))
            full = Gram(segments[segments.part == "full"], origin, span)
            values, halves = _forecast(full, SEASONAL_FC_HORIZON_HOURS)
            row.update(last=full.end, values=values.tolist(), halves=halves.tolist())
            train = Gram(segments[segments.part == "train"], origin, span)
            row.update(begin=train.begin, span=train.span, bends=train.bends.tolist(),
                       beta=(train.solve()[0] * train.scale).tolist(), train_last=train.end)
        except Exception as e:  # noqa: BLE001 - one station's failure must not stop the others
            row.update(status="failed", error_message=str(e)[:500])
        return pd.DataFrame([row], columns=columns)

    return run


def _predicted(epoch: Column) -> Column:
    """The train part's model as a column (numbers of ``predict``)."""
    t = (epoch - F.col("begin")) / F.col("span")
    bent = F.zip_with("bends", F.slice("beta", F.lit(3), F.size("bends")), lambda at, change: F.greatest(t - at, F.lit(0.0)) * change)
    total = F.aggregate(bent, F.col("beta")[0] + F.col("beta")[1] * t, lambda s, x: s + x)
    speeds = [2 * math.pi * j / period / DAY for period, k in WAVES for j in range(1, k + 1)]
    for place, wave in enumerate([F.sin(epoch * s) for s in speeds] + [F.cos(epoch * s) for s in speeds]):
        total = total + wave * F.element_at("beta", F.size("bends") + 3 + place)
    return total


def training_rows(aq: DataFrame, stations: DataFrame, as_of: datetime, metric: str) -> DataFrame:
    """(station_id, obs_id, epoch, y): raw rows of the training window, numbered by (time, id) as ``pos`` of ``n``;
    stations with too few of them are left out."""
    base = active_only(window(aq, as_of, days=SEASONAL_FC_TRAIN_DAYS), stations)
    y = F.col(metric).cast("double")
    rows = base.where(y.isNotNull() & ~F.isnan(y)).select(
        "station_id", "obs_id", (F.unix_micros(F.col("observed_at").cast("timestamp")) / 1e6).alias("epoch"), y.alias("y"))
    sizes = rows.groupBy("station_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEASONAL_FC_MIN_POINTS)
    return attach(positional_index(rows, ["station_id"], ["epoch", "obs_id"]), sizes, "station_id", "inner")


def segment_sums(placed: DataFrame, origin: float, span: float) -> DataFrame:
    """(station, part, segment, place, first, last, largest, value): the sums of products, one row each."""
    split = F.floor(F.col("n") * F.lit(TRAIN_FRACTION))
    parts = F.filter(F.array(F.struct(F.lit("full").alias("part"), F.col("n").alias("size")),
                             F.when(F.col("pos") < split, F.struct(F.lit("train").alias("part"), split.alias("size")))), lambda p: p.isNotNull())
    dealt = placed.select("station_id", "epoch", "y", "pos", F.explode(parts).alias("_p")).select(
        "station_id", "_p.part", _segment(F.col("pos"), F.col("_p.size")).alias("segment"), "epoch", "y")
    sums = dealt.mapInPandas(_sums(origin, span), SUMS_SCHEMA)
    return sums.select("*", F.posexplode("sums").alias("place", "value")).groupBy("station_id", "part", "segment", "place").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("largest").alias("largest"), F.sum("value").alias("value"))


def seasonal_points(aq: DataFrame, stations: DataFrame, as_of: datetime, metric: str = "aqi") -> DataFrame:
    """J5 and its errors (J6): one row per forecast hour, one with empty values for a station whose fit failed."""
    m = metric if metric in METRICS else "aqi"
    origin = (as_of - timedelta(days=SEASONAL_FC_TRAIN_DAYS) - datetime(1970, 1, 1)).total_seconds()
    span = SEASONAL_FC_TRAIN_DAYS * DAY
    placed = training_rows(aq, stations, as_of, m)
    fits = cut_lineage(segment_sums(placed, origin, span).groupBy("station_id").applyInPandas(_fit(origin, span), FIT_SCHEMA))
    sizes = placed.groupBy("station_id").agg(F.max("n").alias("training_rows"))
    split = F.floor(F.col("n") * F.lit(TRAIN_FRACTION))
    held_out = placed.where((F.col("pos") >= split) & (F.col("n") - split >= EVAL_MIN_POINTS)).select(
        "station_id", F.col("y").alias("actual"), (F.col("pos") - split + 1).alias("hours"))
    model = fits.where("status = 'success'").select("station_id", "begin", "span", "bends", "beta", "train_last")
    errors = evaluate(attach(held_out, model, "station_id", "inner").withColumn(
        "predicted", _predicted(F.col("train_last") + F.col("hours") * 3600)), ["station_id"]).drop("n")
    points = fits.join(sizes, "station_id").join(errors, "station_id", "left").select(
        "*", F.posexplode_outer(F.when(F.col("status") == "success", F.arrays_zip("values", "halves"))).alias("step", "_v"))
    value, half = F.col("_v")["values"], F.col("_v")["halves"]
    return points.select(
        "station_id", F.lit("prophet").alias("model_type"), F.lit(m).alias("target_metric"),
        F.lit(SEASONAL_FC_HORIZON_HOURS).alias("horizon_hours"), "training_rows", "status", "error_message",
        *[F.col(c).cast("double").alias(c) for c in ("mae", "rmse", "mape")],
        (F.col("step") + 1).alias("step"), F.bround(value, 2).alias("predicted_value"),
        F.bround(value - half, 2).alias("lower_bound"), F.bround(value + half, 2).alias("upper_bound"),
        F.timestamp_micros(((F.col("last") + (F.col("step") + 1) * 3600) * 1e6).cast("long")).cast("timestamp_ntz").alias("predicted_at"),
        ts_lit(as_of).alias("created_at"))
