"""Read queries of the service API (M1-M17) as DataFrame functions over job outputs.

Optional arguments become filters only when given (B4); bounds are validated like
the API did; list endpoints keep their ORDER BY ... LIMIT (a top-k: Spark plans it
as TakeOrderedAndProject, so no global sort of the whole table).
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import latest_per_key
from ..sources.binding import ts_lit


def _check(name: str, value: int, lo: int, hi: int) -> None:
    if not lo <= value <= hi:
        raise ValueError(f"{name} must be within {lo}..{hi}")


def first_day(as_of: datetime, days: int) -> date:
    """The first day that a list of the last ``days`` days shows."""
    return as_of.date() - timedelta(days=days - 1)


def daily_summaries(summaries: DataFrame, stations: DataFrame, as_of: datetime, days: int = 30,
                    station_id: int | None = None, limit: int = 500) -> DataFrame:
    """M1: summaries of the last ``days`` days, newest first, then station."""
    _check("days", days, 1, 365)
    d = summaries.filter(F.col("summary_date") >= F.lit(first_day(as_of, days)))
    if station_id is not None:
        d = d.filter(F.col("station_id") == station_id)
    d = d.join(stations.select("station_id", F.col("code").alias("station_code")), "station_id")
    return d.orderBy(F.col("summary_date").desc(), F.col("station_code").asc()).limit(limit)


def anomalies(found: DataFrame, stations: DataFrame, as_of: datetime, days: int = 7, station_id: int | None = None,
              severity: str | None = None, limit: int = 200) -> DataFrame:
    """M2: anomalies detected in the last ``days`` days, newest first."""
    _check("days", days, 1, 90)
    a = found.filter(F.col("detected_at") > ts_lit(as_of - timedelta(days=days)))
    if station_id is not None:
        a = a.filter(F.col("station_id") == station_id)
    if severity is not None:
        a = a.filter(F.col("severity") == severity)
    a = a.join(stations.select("station_id", F.col("code").alias("station_code")), "station_id")
    return a.orderBy(F.col("detected_at").desc(), "station_id", "metric", "obs_id").limit(limit)


def health_all(health: DataFrame, stations: DataFrame) -> DataFrame:
    """Health of every active station, worst current AQI first (NULLS LAST)."""
    s = stations.filter("is_active").select("station_id", F.col("code").alias("station_code"))
    return health.join(s, "station_id").orderBy(F.col("current_aqi").desc_nulls_last(), "station_id")


def latest_run(runs: DataFrame, keys: list[str], time_col: str) -> DataFrame:
    """M3/M6-M9 (F4): latest row per key, batch form."""
    return latest_per_key(runs, keys, [time_col], [c for c in runs.columns if c not in keys])


def station_lineage(source_latest: DataFrame, summaries: DataFrame, forecast_points: DataFrame,
                    station_id: int | None = None, limit: int = 20) -> DataFrame:
    """Latest source row, latest analysis (newest summary day) and latest prediction run
    (points count, last target time, last value — D9) per station."""
    _check("limit", limit, 1, 200)
    an = summaries.groupBy("station_id").agg(F.max("summary_date").alias("analysis_date"))
    pr = forecast_points.filter(F.col("step").isNotNull()).groupBy("station_id", "run_id", "created_at").agg(
        F.count(F.lit(1)).alias("prediction_count"), F.max("predicted_at").alias("last_predicted_for"),
        F.max_by("predicted_value", "predicted_at").alias("last_predicted_value"))
    pr = latest_per_key(pr, ["station_id"], ["created_at", "run_id"], ["run_id", "prediction_count", "last_predicted_for", "last_predicted_value"])
    j = source_latest.join(an, "station_id", "left").join(pr, "station_id", "left")
    if station_id is not None:
        j = j.filter(F.col("station_id") == station_id)
    j = j.withColumn("prediction_count", F.coalesce("prediction_count", F.lit(0)))
    return j.orderBy(F.col("observed_at").desc_nulls_last(), "station_code").limit(limit)


def camel_case(df: DataFrame) -> DataFrame:
    """B1: API projection — snake_case columns aliased to camelCase."""
    def camel(name: str) -> str:
        head, *rest = name.split("_")
        return head + "".join(p[:1].upper() + p[1:] for p in rest)

    return df.select(*[F.col(f"`{c}`").alias(camel(c)) for c in df.columns])


def top_k_frequency(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """the k most frequent values of ``key`` (ties by value), as a top-k report."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(key).asc()).limit(k)


def forecast_runs_list(runs: DataFrame, station_id: int | None = None, model_type: str | None = None,
                       limit: int = 20) -> DataFrame:
    """M5: forecast runs, newest first, optional station / model filters, limit 1..100."""
    _check("limit", limit, 1, 100)
    r = runs
    if station_id is not None:
        r = r.filter(F.col("station_id") == station_id)
    if model_type is not None:
        r = r.filter(F.col("model_type") == model_type)
    return r.orderBy(F.col("created_at").desc(), "run_id").limit(limit)


def latest_forecast(points: DataFrame, model_type: str = "linear", metric: str = "aqi") -> DataFrame:
    """M3 (batch form): per station, the latest successful run of ``model_type`` with its points
    as an ordered array."""
    ok = points.filter((F.col("status") == "success") & (F.col("model_type") == model_type) & (F.col("target_metric") == metric))
    last = ok.groupBy("station_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    sel = ok.join(last, ["station_id", "run_id"], "left_semi")
    return sel.groupBy("station_id", "run_id", "model_type", "mae", "rmse", "mape").agg(
        F.array_sort(F.collect_list(F.struct("step", "predicted_at", "predicted_value", "lower_bound", "upper_bound"))).alias("points"))
