"""I2 — anomaly detection (z-score + IQR) for every (station, metric) at once.

History = last 7 days (including the scanned rows); candidates = rows of the last
``scan_hours``.  Stats are one grouped aggregate over the long form; candidates
join their key's stats (one row per key).  Suppression (C18) keeps a candidate
only when no prior anomaly of the same key has ``detected_at > observed_at - 1h``;
that condition has no upper bound, so it reduces to comparing with the key's
*latest* prior detection — a per-key ``max`` aggregate, then an equi-join.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (
    ANOMALY_HISTORY_DAYS, ANOMALY_MIN_HISTORY, ANOMALY_SCAN_HOURS, IQR_FACTOR, METRICS, SUPPRESS_HOURS,
    ZSCORE_THRESHOLD,
)
from ..functions import anomaly_severity
from ..functions.numeric import round_half_up
from ..operators.positional import exact_percentiles
from .common import active_only, to_long, window


def metric_stats(aq: DataFrame, stations: DataFrame, as_of: datetime, history_days: int = ANOMALY_HISTORY_DAYS,
                 metrics: list[str] = METRICS) -> DataFrame:
    hist = to_long(active_only(window(aq, as_of, days=history_days), stations), ["station_id"], metrics)
    spread = (
        hist.groupBy("station_id", "metric")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean"),
            # a constant history has std 0 exactly (merged floating moments may leave ~1e-16)
            F.when(F.min("value") < F.max("value"), F.stddev_pop("value")).otherwise(F.lit(0.0)).alias("std"),
        )
        .filter(F.col("n") >= ANOMALY_MIN_HISTORY)
    )
    return spread.join(exact_percentiles(hist, ["station_id", "metric"], "value", {"q1": 0.25, "q3": 0.75}), ["station_id", "metric"])


def metric_stats_of_counts(counts: DataFrame, stations: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """``metric_stats`` from (station_id, metric, value, n): how often each value of the history occurs."""
    keys, v, n = ["station_id", "metric"], F.col("value"), F.col("n")
    held = active_only(counts.where(F.col("metric").isin(metrics)), stations).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    level = held.groupBy(*keys).agg((F.sum(v * n) / F.sum("n")).alias("mean"))  # one row per key
    spread = held.join(level, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("mean").alias("mean"),
        F.when(F.min("value") < F.max("value"), F.sqrt(F.sum((v - F.col("mean")) ** 2 * n) / F.sum("n"))).otherwise(F.lit(0.0)).alias("std"))
    quartiles = exact_percentiles(held, keys, "value", {"q1": 0.25, "q3": 0.75}, F.col("n"))
    return spread.filter(F.col("n") >= ANOMALY_MIN_HISTORY).join(quartiles, keys)


def score_candidates(recent_long: DataFrame, stats: DataFrame) -> DataFrame:
    """z-score and IQR tests of long-form rows (station_id, metric, observed_at, obs_id, value)
    against their key's stats (one row per key, so the join never fans out); keeps anomalies.
    Works on batch and streaming inputs alike (stream-static join)."""
    c = recent_long.join(stats, ["station_id", "metric"])
    v, mean, std, q1, q3 = (F.col(x) for x in ("value", "mean", "std", "q1", "q3"))
    iqr = q3 - q1
    lower, upper = q1 - IQR_FACTOR * iqr, q3 + IQR_FACTOR * iqr
    z = F.when(std > 0, (v - mean) / std).otherwise(F.lit(0.0))
    f_hi = F.when((iqr > 0) & (v > upper), (v - upper) / iqr).otherwise(F.lit(0.0))
    f_lo = F.when((iqr > 0) & (v < lower), (lower - v) / iqr).otherwise(F.lit(0.0))
    c = c.select(
        "station_id", "metric", "obs_id", F.col("observed_at").alias("detected_at"), "value", "mean", "std",
        lower.alias("iqr_lower"), upper.alias("iqr_upper"), z.alias("z"), F.greatest(f_hi, f_lo).alias("f"),
    )
    is_z = F.abs(F.col("z")) >= ZSCORE_THRESHOLD
    is_iqr = (F.col("value") < F.col("iqr_lower")) | (F.col("value") > F.col("iqr_upper"))
    return c.filter(is_z | is_iqr).withColumn("method", F.when(is_z, F.lit("zscore")).otherwise(F.lit("iqr")))


def detect_anomalies(
    aq: DataFrame,
    stations: DataFrame,
    as_of: datetime,
    scan_hours: float = ANOMALY_SCAN_HOURS,
    prior: DataFrame | None = None,
    metrics: list[str] = METRICS,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Rows: station_id, metric, detected_at, value, z_score, iqr_factor, method, severity, description.
    ``stats``: those of the history where they are known already."""
    stats = metric_stats(aq, stations, as_of, metrics=metrics) if stats is None else stats
    recent = to_long(window(aq, as_of, hours=scan_hours), ["station_id", "observed_at", "obs_id"], metrics)
    c = score_candidates(recent, stats)

    if prior is not None:
        last = prior.groupBy("station_id", "metric").agg(F.max("detected_at").alias("_last"))
        c = c.join(last, ["station_id", "metric"], "left")
        c = c.filter(
            F.col("_last").isNull()
            | ~(F.col("_last") > F.col("detected_at") - F.expr(f"INTERVAL {SUPPRESS_HOURS} HOURS"))
        ).drop("_last")

    up = F.upper(F.col("metric"))
    desc = F.when(
        F.col("method") == "zscore",
        F.format_string("%s = %.1f (mean=%.1f, std=%.1f, z=%.2f)", up, *[round_half_up(c, 1) for c in ("value", "mean", "std")], round_half_up("z", 2)),
    ).otherwise(
        F.format_string("%s = %.1f nằm ngoài IQR [%.1f, %.1f]", up, *[round_half_up(c, 1) for c in ("value", "iqr_lower", "iqr_upper")])
    )
    return c.select(
        "station_id", "metric", "obs_id", "detected_at", "value",
        F.bround("z", 3).alias("z_score"), F.bround("f", 3).alias("iqr_factor"), "method",
        anomaly_severity(F.col("z"), F.col("f")).alias("severity"), desc.alias("description"),
    )
