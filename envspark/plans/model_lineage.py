"""Model registry lineage derived from forecast runs.

Registry = one model per (model type, station); each run is a model version with its
metrics as a JSON document, a training run and (when successful) a prediction run
whose points are the predictions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import latest_per_key
from ..sources.binding import ts_lit
from .forecast import forecast_runs


def model_tables(points: DataFrame, as_of: datetime) -> dict[str, DataFrame]:
    runs = forecast_runs(points)
    t = ts_lit(as_of)
    model_id = F.concat_ws("-", F.col("model_type"), F.col("station_id").cast("string"))
    registry = runs.select(model_id.alias("model_id"), F.col("model_type").alias("model_code"), "station_id",
                           F.col("target_metric").alias("target"), F.lit("active").alias("model_status")).distinct()
    metrics = F.to_json(F.struct("mae", "rmse", "mape"))
    versions = runs.select(
        F.col("run_id").alias("version_id"), model_id.alias("model_id"), F.lit(as_of.strftime("v%Y%m%d%H")).alias("version"),
        F.lit("numpy").alias("training_library"), metrics.alias("metrics"), (F.col("status") == "success").alias("is_production"),
        t.alias("created_at"), F.when(F.col("status") == "success", t).alias("released_at"))
    training = runs.select(F.concat(F.col("run_id"), F.lit("-train")).alias("training_run_id"), F.col("run_id").alias("model_version_id"),
                           t.alias("started_at"), t.alias("finished_at"), "status", F.col("training_rows").alias("sample_count"), metrics.alias("metrics"))
    pred_runs = runs.filter(F.col("status") == "success").select(
        F.concat(F.col("run_id"), F.lit("-predict")).alias("prediction_run_id"), F.col("run_id").alias("model_version_id"),
        "station_id", t.alias("created_at"), F.lit("success").alias("status"))
    preds = points.filter(F.col("step").isNotNull()).select(
        F.concat_ws("-", F.col("run_id"), F.col("step").cast("string")).alias("prediction_id"),
        F.concat(F.col("run_id"), F.lit("-predict")).alias("prediction_run_id"), F.col("run_id").alias("model_version_id"),
        "station_id", F.col("target_metric").alias("target"), F.col("predicted_at").alias("predicted_for"), "predicted_value")
    return {"registry": registry, "versions": versions, "training_runs": training, "prediction_runs": pred_runs, "predictions": preds}


def model_versions_listing(tables: dict[str, DataFrame]) -> DataFrame:
    """M13 with H14: ``coalesce(metrics->>'mae', 0)``."""
    v = tables["versions"].join(tables["registry"].select("model_id", "model_code", "target"), "model_id")
    mae = F.coalesce(F.get_json_object("metrics", "$.mae").cast("double"), F.lit(0.0))
    return v.select("version_id", "model_code", "version", "target", "is_production", mae.alias("mae"),
                    F.coalesce("released_at", "created_at").alias("updated_at")).orderBy(F.col("updated_at").desc(), "version_id")


def predictions_listing(tables: dict[str, DataFrame], stations: DataFrame, limit: int = 100) -> DataFrame:
    """Earliest predictions first (a top-k report)."""
    p = tables["predictions"].join(stations.select("station_id", F.col("code").alias("station_code")), "station_id")
    p = p.join(tables["versions"].select(F.col("version_id").alias("model_version_id"), "version"), "model_version_id", "left")
    return p.select("prediction_id", "station_code", "target", "predicted_for", "predicted_value", F.col("version").alias("model_version")) \
        .orderBy("predicted_for", "prediction_id").limit(limit)


def model_production_status(tables: dict[str, DataFrame], stations: DataFrame) -> DataFrame:
    """Each model with its production version, latest training run and latest prediction run."""
    reg = tables["registry"].join(stations.select("station_id", F.col("code").alias("station_code")), "station_id", "left")
    prod = tables["versions"].filter("is_production").select("model_id", "version_id", "version", "training_library",
                                                            F.col("metrics").alias("version_metrics"), "released_at")
    lt = latest_per_key(tables["training_runs"], ["model_version_id"], ["started_at", "training_run_id"],
                        ["started_at", "status", "sample_count", "metrics"])
    lt = lt.select(F.col("model_version_id").alias("version_id"), F.col("started_at").alias("last_trained_at"),
                   F.col("status").alias("last_training_status"), "sample_count", F.col("metrics").alias("training_metrics"))
    lp = latest_per_key(tables["prediction_runs"], ["model_version_id"], ["created_at", "prediction_run_id"], ["created_at", "status"])
    lp = lp.select(F.col("model_version_id").alias("version_id"), F.col("created_at").alias("last_prediction_at"),
                   F.col("status").alias("last_prediction_status"))
    return reg.join(prod, "model_id", "left").join(lt, "version_id", "left").join(lp, "version_id", "left")


def prediction_full_lineage(tables: dict[str, DataFrame], stations: DataFrame) -> DataFrame:
    """Prediction -> prediction run -> model version (C9: the prediction's own version,
    else its run's) -> registry -> the successful training run of that version that finished last."""
    p = tables["predictions"].withColumnRenamed("model_version_id", "p_version")
    pr = tables["prediction_runs"].select("prediction_run_id", F.col("model_version_id").alias("run_version"),
                                          F.col("created_at").alias("prediction_run_at"), F.col("status").alias("prediction_run_status"))
    j = p.join(pr, "prediction_run_id").withColumn("version_id", F.coalesce("p_version", "run_version"))
    v = tables["versions"].select("version_id", "model_id", "version", "training_library", F.col("metrics").alias("version_metrics"))
    reg = tables["registry"].select("model_id", "model_code", F.col("target").alias("model_target"))
    done = tables["training_runs"].filter(F.col("status") == "success")
    # max_by orders nulls first, so a run without an end comes last here
    lt = latest_per_key(done, ["model_version_id"], ["finished_at", "training_run_id"],
                        ["training_run_id", "started_at", "finished_at", "status", "sample_count"])
    lt = lt.select(F.col("model_version_id").alias("version_id"), "training_run_id", F.col("started_at").alias("trained_at"),
                   F.col("status").alias("training_status"), "sample_count")
    st = stations.select("station_id", F.col("code").alias("station_code"))
    return (j.join(v, "version_id").join(reg, "model_id").join(lt, "version_id", "left")
            .join(st, "station_id").drop("p_version", "run_version"))
