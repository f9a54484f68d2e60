"""Rules of the lineage views and of ingest that the bound tables do not exercise by themselves."""

from datetime import datetime

from pyspark.sql import functions as F

from envspark.operators import dimension
from envspark.plans.api import forecast_runs_list
from envspark.plans.grid import fuse, latest_grid
from envspark.plans.lineage import observation_full_lineage
from envspark.plans.model_lineage import prediction_full_lineage
from envspark.sources.payload import normalise_payloads

T = datetime(2024, 1, 1, 10)


def test_payload_without_time_counts_for_its_fetch(spark):
    doc = '{"grid_point_id": 7, "fetched_at": "2024-01-01 10:20:30.000000", "current": {%s"us_aqi": 41}}'
    rows = [(1, doc % ""), (2, doc % '"time": "", '), (3, doc % '"time": "2024-01-01T17:00", '), (4, doc % '"time": null, ')]
    got = {r["payload_id"]: r["observed_at"] for r in normalise_payloads(spark.createDataFrame(rows, "payload_id long, json string")).collect()}
    fetched = datetime(2024, 1, 1, 10, 20, 30)
    assert got == {1: fetched, 2: fetched, 3: T, 4: fetched}


def test_prediction_lineage_takes_the_successful_run_that_finished_last(spark):
    end = lambda h: datetime(2024, 1, 1, h)
    tables = {
        "predictions": spark.createDataFrame([("p", "pr", None, 1, "aqi", T, 5.0), ("lost", "no run", None, 1, "aqi", T, 6.0)],
            "prediction_id string, prediction_run_id string, model_version_id string, station_id int, target string, predicted_for timestamp_ntz, predicted_value double"),
        "prediction_runs": spark.createDataFrame([("pr", "v", 1, T, "success")],
            "prediction_run_id string, model_version_id string, station_id int, created_at timestamp_ntz, status string"),
        "versions": spark.createDataFrame([("v", "m", "1", "numpy", "{}")],
            "version_id string, model_id string, version string, training_library string, metrics string"),
        "registry": spark.createDataFrame([("m", "linear", "aqi")], "model_id string, model_code string, target string"),
        "training_runs": spark.createDataFrame(
            [("old", "v", end(1), end(2), "success", 1), ("new", "v", end(1), end(4), "success", 2),
             ("failed", "v", end(6), end(7), "failed", 3), ("open", "v", end(8), None, "success", 4)],
            "training_run_id string, model_version_id string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, sample_count int"),
    }
    stations = spark.createDataFrame([(1, "ST-1")], "station_id int, code string")
    got = prediction_full_lineage(tables, stations).collect()
    assert [(r["prediction_id"], r["training_run_id"]) for r in got] == [("p", "new")]


def test_observations_share_the_newest_request_of_their_run(spark):
    rows = [(1, 1, T, "waqi", 5, datetime(2024, 1, 1, 10, 1), "e", "run", "pay-1", "n"),
            (2, 2, T, "waqi", 6, datetime(2024, 1, 1, 10, 9), "e", "run", "pay-2", "n"),
            (3, 9, T, "waqi", 7, datetime(2024, 1, 1, 10, 3), "e", "run", "pay-3", "n")]
    aq = spark.createDataFrame(rows, "obs_id long, station_id int, observed_at timestamp_ntz, provider_code string, aqi int, "
                               "fetched_at timestamp_ntz, endpoint_code string, pipeline_run_id string, raw_payload_id string, normalize_run_id string")
    stations = spark.createDataFrame([(1, "ST-1"), (2, "ST-2")], "station_id int, code string")
    got = {r["obs_id"]: r["request_id"] for r in observation_full_lineage(aq, stations).collect()}
    assert got == {1: "pay-2", 2: "pay-2"}  # station 9 is unknown


def test_fused_rows_are_fused_again_from_their_baseline(spark):
    points = spark.createDataFrame([(1, 10.0, 105.0, True, True)], "grid_point_id int, lat double, lng double, is_active boolean, is_land boolean")
    obs = spark.createDataFrame([(1, T, 90, "fused", 40, "openmeteo")],
                                "grid_point_id int, observed_at timestamp_ntz, aqi int, source_code string, base_aqi int, base_source string")
    stations = spark.createDataFrame([], "station_id int, aqi int, lat double, lng double")
    row = fuse(latest_grid(obs, points, T), stations).first()
    assert (row["base_aqi"], row["aqi"], row["source_code"]) == (40, 40, "openmeteo")
    assert latest_grid(obs, points, T, sources=None).first()["aqi"] == 90


def test_runs_are_listed_by_time_not_by_name(spark):
    runs = spark.createDataFrame([("z", 1, "linear", datetime(2024, 1, 1)), ("a", 1, "linear", datetime(2024, 1, 2))],
                                 "run_id string, station_id int, model_type string, created_at timestamp_ntz")
    assert [r["run_id"] for r in forecast_runs_list(runs).collect()] == ["a", "z"]


def test_large_dimensions_are_not_broadcast(spark, monkeypatch):
    fact = spark.range(20).select((F.col("id") % 4).alias("k"), "id")
    dim = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    small = dimension.attach(fact, dim, "k")
    assert "broadcast" in plan(small)
    monkeypatch.setattr(dimension, "MAX_BROADCAST_ROWS", 2)
    large = dimension.attach(fact, dim, "k")
    assert "broadcast" not in plan(large)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
