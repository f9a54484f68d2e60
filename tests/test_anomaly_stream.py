"""O2: the state of the anomaly stream against the batch job."""

from datetime import timedelta

import pytest

from envspark.plans.anomaly import detect_anomalies
from envspark.sources.binding import AS_OF, Bound
from envspark.streaming.jobs import ingest_anomaly_state, read_anomalies, scan_anomalies, stream_root
from tests.conftest import SF_MID, SF_SMALL

HOURS = 24


def _rows(df):
    return sorted((r["station_id"], r["metric"], r["obs_id"], r["detected_at"], round(r["value"], 6), r["z_score"], r["iqr_factor"],
                   r["method"], r["severity"]) for r in df.collect())


@pytest.fixture(scope="module")
def batch(spark):
    b = Bound(spark, SF_MID)
    before = AS_OF - timedelta(hours=12)
    first = detect_anomalies(b.aq, b.stations, before, scan_hours=HOURS)
    return b.stations, before, _rows(first), _rows(detect_anomalies(b.aq, b.stations, AS_OF, scan_hours=HOURS, prior=first))


@pytest.mark.parametrize("files", [1, 4, 8])
def test_result_does_not_depend_on_the_batches(spark, tmp_path, batch, files):
    stations, before, first, second = batch
    spark.read.parquet(f"{SF_MID}/events.parquet").repartition(files, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    root = stream_root(spark, "test-anomalies")
    ingest_anomaly_state(spark, str(tmp_path), root)
    assert first and second
    assert _rows(scan_anomalies(spark, root, stations, before, HOURS)) == first
    assert _rows(scan_anomalies(spark, root, stations, AS_OF, HOURS)) == second
    if files == 4:
        assert _rows(scan_anomalies(spark, root, stations, AS_OF, HOURS)) == second  # a repeated scan replaces itself
        assert read_anomalies(spark, root).count() == len(first) + len(second)
        assert spark.read.parquet(f"{root}/counts").select("epoch").distinct().count() == files
        with pytest.raises(ValueError):
            scan_anomalies(spark, root, stations, AS_OF + timedelta(minutes=1))


def test_window_ends_belong_to_the_hour_that_ends(spark, tmp_path):
    """A row at the start of the history is left out, one at ``as_of`` is in."""
    start = AS_OF - timedelta(days=7)
    rows = [(k, start + timedelta(hours=k), 1, "click", 10.0 + k % 5, "{'k': 10}") for k in range(169)] + [(900, AS_OF, 1, "click", 400.0, "{'k': 10}")]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string") \
        .write.parquet(f"{tmp_path}/events.parquet")
    root = stream_root(spark, "test-ends")
    ingest_anomaly_state(spark, str(tmp_path), root)
    b = Bound(spark, str(tmp_path))
    stations = b.stations
    want = _rows(detect_anomalies(b.aq, stations, AS_OF, scan_hours=3))
    assert want and _rows(scan_anomalies(spark, root, stations, AS_OF, 3)) == want


def test_scan_reads_no_old_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.read.parquet(f"{SF_SMALL}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    root = stream_root(spark, "test-prune")
    ingest_anomaly_state(spark, str(tmp_path), root)
    rows = spark.read.parquet(f"{root}/rows").where(F.col("day") >= F.lit((AS_OF - timedelta(hours=24)).date()))
    assert "PartitionFilters: [isnotnull(day" in rows._jdf.queryExecution().toString()
