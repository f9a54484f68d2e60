"""Hourly stream (O3): event-time windows publish hours once, late readings become corrections, totals stay whole."""

import os
import shutil
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from envspark.streaming import jobs as J

START = datetime(2024, 1, 1)


def _event(i, hours, user=5):
    return i, START + timedelta(hours=hours), user, "click", float(10 + i), '{"k": 1}'


def _write(spark, folder, batches):
    """One file a batch, in this order of arrival."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, J.EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/part{i}")
    os.makedirs(f"{folder}/events.parquet", exist_ok=True)
    now = time.time() - 1000
    for i in range(len(batches)):
        name = next(n for n in os.listdir(f"{folder}/part{i}") if n.endswith(".parquet"))
        target = f"{folder}/events.parquet/{i:03d}.parquet"
        shutil.copy(f"{folder}/part{i}/{name}", target)
        os.utime(target, (now + 10 * i, now + 10 * i))
    return str(folder)


def test_late_readings_become_corrections(spark, tmp_path):
    early = [_event(1, 0.2), _event(2, 0.4), _event(3, 1.5)]
    later = [_event(4, 9.5)]  # moves the watermark to 7:00
    more = [_event(5, 10.5)]
    late = [_event(6, 0.9), _event(7, 1.7, user=6), _event(8, 10.6)]
    sf = _write(spark, tmp_path, [early, later, more, late])
    got = {(r.station_id, r.hour.hour): r for r in J.stream_hourly_windows(spark, sf, max_files_per_trigger=1).collect()}
    assert (got[5, 0].status, got[5, 0].samples, got[5, 0].late) == ("corrected", 3, 1)
    assert got[5, 0].aqi_avg == pytest.approx((11 + 12 + 16) / 3)
    assert (got[5, 1].status, got[5, 1].late) == ("final", 0)
    assert got[6, 1].samples == 1 and got[6, 1].status == "open"  # its hour of this station was never published
    assert got[5, 10].status == "open" and got[5, 10].samples == 2


@pytest.mark.parametrize("files", [1, 4, 8])
def test_totals_do_not_depend_on_the_order_of_files(spark, tmp_path, files):
    rows = [_event(i, (i * 37 % 400) / 10, user=i % 4) for i in range(400)]
    sf = _write(spark, tmp_path, [rows[k::files] for k in range(files)])
    got = {(r.station_id, r.hour): (r.samples, r.aqi_avg) for r in J.stream_hourly_windows(spark, sf, max_files_per_trigger=1).collect()}
    batch = J._aq_from_events(spark.createDataFrame(rows, J.EVENTS_SCHEMA)).groupBy(
        "station_id", F.date_trunc("hour", "observed_at").alias("hour")).agg(F.count("*").alias("n"), F.avg("aqi").alias("mean"))
    want = {(r.station_id, r.hour): (r.n, r["mean"]) for r in batch.collect()}
    assert got == want and len(got) > 100


def test_publishing_goes_on_where_it_stopped(spark, tmp_path):
    sf = _write(spark, tmp_path, [[_event(1, 0.2)], [_event(2, 8.2)], [_event(3, 9.2)]])
    root = J.stream_root(spark, "hourly-again")
    J.ingest_hourly_sums(spark, sf, root)
    J.publish_hours(spark, root, max_files_per_trigger=1)
    first = J.published_hours(spark, root).where("status = 'final'").count()
    J.publish_hours(spark, root, max_files_per_trigger=1)  # nothing new: no hour twice
    rows = J.published_hours(spark, root).collect()
    assert first == 1 and len(rows) == 3 and sum(r.status == "final" for r in rows) == 1
