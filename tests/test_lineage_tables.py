"""Lineage tables come from one landing of the observations."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from envspark.plans.api import first_day
from envspark.plans.lineage import observation_full_lineage, pipeline_run_overview, provider_health
from envspark.plans.views import station_latest_air_quality
from envspark.sources import lineage as LT
from envspark.sources.binding import AS_OF, Bound
from tests.conftest import SF_SMALL

T = datetime(2024, 1, 1, 10)
AQ = ("obs_id long, station_id int, observed_at timestamp_ntz, provider_code string, aqi int, fetched_at timestamp_ntz, endpoint_code string, "
      "pipeline_run_id string, raw_payload_id string, normalize_run_id string")


def _scans(df):
    """Reads of files; cached dimensions do not count."""
    return len(re.findall(r"(?<!Memory)Relation \[.*parquet", df._jdf.queryExecution().optimizedPlan().toString()))


def test_observations_are_read_once_behind_the_landing(spark):
    b = Bound(spark, SF_SMALL)
    assert _scans(provider_health(b.aq, AS_OF)) == 0
    assert _scans(pipeline_run_overview(b.aq)) == 0
    assert _scans(observation_full_lineage(b.aq, b.stations)) == 1


def test_runs_tell_what_failed(spark):
    rows = [(17, 1, T, "waqi", 5, T, "e", "run", "p1", "n"), (18, 1, T, "waqi", None, T, "e", "run", "p2", "n"),
            (19, 2, T, "waqi", 7, T, "e", "run", "p2x", "n"), (20, 2, T, "waqi", 7, T, "e", "good", "p3", "n2")]
    aq = spark.createDataFrame(rows, AQ)
    got = {r.id: r for r in pipeline_run_overview(aq).collect()}
    assert (got["run"].status, got["run"].error_summary) == ("partial", "1 of 3 requests failed")
    assert got["run"].metrics == '{"requests":3,"failed_requests":1,"records":3}'
    assert got["good"].error_summary is None and got["good"].pipeline_name == "WAQI ingest"
    n = {r.normalize_run_id: (r.records_in, r.records_out) for r in LT.normalize_runs(LT.payloads(aq)).collect()}
    assert n == {"n": (3, 2), "n2": (1, 1)}


def test_weather_of_the_observation_goes_first(spark):
    values = "station_id int, obs_id long, observed_at timestamp_ntz, fetched_at timestamp_ntz, temperature_c double, humidity_pct double, wind_speed_mps double"
    aq = spark.createDataFrame([(1, 1, T, T, 30.0, None, None), (2, 2, T, T, None, 50.0, None)], values)
    for c in ["aqi", "pm25", "pm10", "o3", "no2", "so2", "co"]:
        aq = aq.withColumn(c, F.lit(1.0))
    aq = aq.withColumn("provider_code", F.lit("p")).withColumn("endpoint_code", F.lit("e"))
    wx = spark.createDataFrame([(1, 5, T, T, 20.0, 60.0, 3.0), (2, 6, T, T, 21.0, 61.0, 4.0), (3, 7, T, T, 22.0, 62.0, 5.0)], values)
    stations = spark.createDataFrame([(i, f"ST-{i}", 1.0, 2.0, True) for i in (1, 2, 3)], "station_id int, code string, lat double, lng double, is_active boolean")
    latest = lambda facts: {r.station_id: (r.temperature_c, r.humidity_pct, r.wind_speed_mps)
                            for r in station_latest_air_quality(facts, wx, stations, T).collect()}
    assert latest(aq) == {1: (30.0, 60.0, 3.0), 2: (21.0, 50.0, 4.0), 3: (22.0, 62.0, 5.0)}
    assert latest(aq.drop("temperature_c", "humidity_pct", "wind_speed_mps")) == {1: (20.0, 60.0, 3.0), 2: (21.0, 61.0, 4.0), 3: (22.0, 62.0, 5.0)}


def test_lists_of_days_start_after_the_span(spark):
    assert first_day(AS_OF, 30) == (AS_OF - timedelta(days=29)).date()
