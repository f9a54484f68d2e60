"""Streaming equivalents of the polling jobs (O1-O3).

* Source: the events table read as a file stream (``readStream.parquet`` with a
  path filter), so a landing folder that receives new files keeps feeding the job.
* O1 ``stream_grid_ingest``: readings -> keyed upsert (N1) into a date-partitioned
  Parquet table in ``foreachBatch``: only the partitions a batch touches are read,
  merged, checkpointed (cuts the read-back lineage) and dynamically overwritten.
* O2 ``ingest_anomaly_state``: each micro-batch adds how often each value occurs per hour, station and
  metric, and its rows by day; ``scan_anomalies`` takes the 7-day statistics from these counts, so the history
  is never read again, scores the rows of the scanned hours and suppresses against earlier scans (C18).
  The counts are totals, so the result does not depend on how files fall into batches.
* O3 ``stream_hourly``: sums and counts per (station, hour) of every micro-batch, totalled on
  reading — no watermark, so readings in files out of time order are not lost.  ``publish_hours`` streams
  these sums through event-time windows: an hour is published once, when the watermark passes its end;
  what comes later is its correction, so published and corrected sums make the same totals.

All state (stream checkpoints, tables) lives under the session's shared
``spark.checkpoint.dir``; nothing uses a machine-local folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import latest_version, write_partitioned_upsert
from ..session import cut_lineage, ensure_checkpoint_dir

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_root(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/envspark-streams/{name}-{uuid.uuid4().hex[:12]}"


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of its files, be it one file or a folder of part files (the glob
    lets a single file pass as a source path)."""
    return (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(f"{sf_dir.rstrip('/')}/events.parque[t]"))


def _table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def upsert_partitioned(batch: DataFrame, path: str, keys: list[str], part_col: str, version: Sequence[str] = ("_seq",)) -> None:
    """N1 on Parquet: merge ``batch`` into the partitions it touches; the greatest ``version`` (columns
    of the table) wins, so that the result depends neither on the order nor on the number of batches."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        new = batch
        if _table_exists(spark, path):
            touched = [r[0] for r in batch.select(part_col).distinct().collect()]  # partition values of one batch
            # explicit schema: empty batches leave no files to infer from; literals prune partitions
            new = spark.read.schema(batch.schema).parquet(path).filter(F.col(part_col).isin(touched)).select(*batch.columns).unionByName(batch)
        merged = cut_lineage(latest_version(new, keys, version))  # the write below may replace files the merge read
        write_partitioned_upsert(merged, path, [part_col])
    finally:
        batch.unpersist()


def _run(query_builder, root: str) -> None:
    q = query_builder.option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))


def stream_grid_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: events -> grid readings -> keyed upsert by (grid_point_id, observed_at). Returns the table."""
    from ..sources.grid import GRID_SPREAD, N_POINTS, OPENMETEO_CONFIDENCE, OPENMETEO_SOURCE, RASTER_CONFIDENCE, RASTER_SOURCE

    root = stream_root(spark, "grid-ingest")
    table = f"{root}/grid_observations"
    src = F.when(F.col("event_type") == "view", F.lit(RASTER_SOURCE)).otherwise(F.lit(OPENMETEO_SOURCE))
    readings = events_stream(spark, sf_dir).select(
        F.col("event_id").alias("reading_id"),
        F.pmod(F.col("event_id") * GRID_SPREAD, F.lit(N_POINTS)).cast("int").alias("grid_point_id"),
        F.date_trunc("hour", F.col("ts")).alias("observed_at"),
        F.floor(F.col("value")).cast("int").alias("aqi"), (F.col("value") * 0.4).alias("pm25"), (F.col("value") * 0.8).alias("pm10"),
        src.alias("source_code"),
        F.when(src == RASTER_SOURCE, F.lit(RASTER_CONFIDENCE)).otherwise(F.lit(OPENMETEO_CONFIDENCE)).alias("confidence_score"),
        F.col("ts").alias("fetched_at"),
    ).withColumn("obs_date", F.to_date("observed_at"))

    def sink(batch: DataFrame, _epoch: int) -> None:
        upsert_partitioned(batch, table, ["grid_point_id", "observed_at"], "obs_date", ["fetched_at", "reading_id"])

    _run(readings.writeStream.foreachBatch(sink), root)
    return spark.read.schema(readings.schema).parquet(table)


def _aq_from_events(ev: DataFrame) -> DataFrame:
    from ..sources.binding import AQ_EVENT_TYPES, N_STATIONS

    b = ev.filter(F.col("event_type").isin(AQ_EVENT_TYPES))
    oid, v = F.col("event_id"), F.col("value")
    k = F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)")
    return b.select(
        oid.alias("obs_id"), (F.col("user_id") % N_STATIONS).cast("int").alias("station_id"), F.col("ts").alias("observed_at"),
        F.floor(v).cast("int").alias("aqi"), (v * 0.4 + k * 0.1).alias("pm25"), (v * 0.8 + k * 0.2).alias("pm10"),
        F.when(oid % 7 == 0, F.lit(None).cast("double")).otherwise(k).alias("o3"),
        F.when(oid % 5 == 0, F.lit(None).cast("double")).otherwise(F.lit(100.0) - k + v * 0.05).alias("no2"),
        (oid % 23).cast("double").alias("so2"), F.lit(3.5).cast("double").alias("co"),
    )


HOURLY_SCHEMA = "station_id int, hour timestamp_ntz, total long, known long, samples long"
#: Hours wait so long for late readings before they are published.
HOURLY_DELAY = "2 hours"


def ingest_hourly_sums(spark: SparkSession, sf_dir: str, root: str, max_files_per_trigger: int = 1) -> None:
    """O3, ledger: sums and counts per station and hour under ``root``.  Each micro-batch leaves a folder of
    its own, written anew if the batch is repeated."""
    from ..session import pin_utc

    pin_utc(spark)

    def sink(batch: DataFrame, epoch: int) -> None:
        partial = batch.groupBy("station_id", F.date_trunc("hour", "observed_at").alias("hour")).agg(
            F.sum("aqi").alias("total"), F.count("aqi").alias("known"), F.count(F.lit(1)).alias("samples"))
        partial.write.mode("overwrite").parquet(f"{root}/hourly/epoch={epoch}")

    _run(_aq_from_events(events_stream(spark, sf_dir, max_files_per_trigger)).writeStream.foreachBatch(sink), root)


def hourly_totals(spark: SparkSession, root: str) -> DataFrame:
    """Station, hour and the totals of the ledger."""
    sums = spark.read.schema(HOURLY_SCHEMA).parquet(f"{root}/hourly")
    return sums.groupBy("station_id", "hour").agg(*[F.sum(c).alias(c) for c in ("total", "known", "samples")])


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: hourly AQI mean and count per station from the event stream.

    Files need not come in time order: the table is the total of all micro-batches, so no reading is late."""
    root = stream_root(spark, "hourly")
    ingest_hourly_sums(spark, sf_dir, root)
    return hourly_totals(spark, root).select("station_id", "hour", (F.col("total") / F.col("known")).alias("aqi_avg"), "samples")


def publish_hours(spark: SparkSession, root: str, delay: str = HOURLY_DELAY, max_files_per_trigger: int = 1000) -> None:
    """O3, windows: the ledger's new sums through event-time windows of an hour; hours that end ``delay`` before
    the newest one begins are appended to ``published``, each once.  The state holds the sums of open hours only."""
    sums = (spark.readStream.schema(HOURLY_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(f"{root}/hourly/epoch=*")
            .withColumn("at", F.col("hour").cast("timestamp")).withWatermark("at", delay))
    hours = sums.groupBy(F.window("at", "1 hour").alias("w"), "station_id").agg(*[F.sum(c).alias(c) for c in ("total", "known", "samples")])
    rows = hours.select("station_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "total", "known", "samples")
    q = (rows.writeStream.format("parquet").option("path", f"{root}/published").option("checkpointLocation", f"{root}/_publish")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))


def published_hours(spark: SparkSession, root: str) -> DataFrame:
    """Hours as published, with the corrections that later readings make: ``status`` is final, corrected or open
    (not published yet); ``late`` counts the readings that came after their hour was published.  The sums are
    those of the ledger, whatever the watermark left out."""
    out = spark.read.schema(HOURLY_SCHEMA).parquet(f"{root}/published").select(
        "station_id", "hour", F.col("samples").alias("published"))
    j = hourly_totals(spark, root).join(out, ["station_id", "hour"], "left")
    status = F.when(F.col("published").isNull(), "open").when(F.col("published") == F.col("samples"), "final").otherwise("corrected")
    return j.select("station_id", "hour", (F.col("total") / F.col("known")).alias("aqi_avg"), "samples", status.alias("status"),
                    F.when(F.col("published").isNull(), 0).otherwise(F.col("samples") - F.col("published")).alias("late"))


def stream_hourly_windows(spark: SparkSession, sf_dir: str, delay: str = HOURLY_DELAY, max_files_per_trigger: int = 1000) -> DataFrame:
    """O3 with event-time windows: the whole stream, then its hours with status and corrections."""
    root = stream_root(spark, "hourly-windows")
    ingest_hourly_sums(spark, sf_dir, root)
    publish_hours(spark, root, delay, max_files_per_trigger)
    return published_hours(spark, root)


COUNTS_SCHEMA = "hour timestamp_ntz, station_id int, metric string, value double, n long"
ROWS_SCHEMA = ("obs_id long, station_id int, observed_at timestamp_ntz, aqi int, pm25 double, pm10 double, o3 double, no2 double, "
               "so2 double, co double, day date")
ANOMALY_SCHEMA = ("station_id int, metric string, obs_id long, detected_at timestamp_ntz, value double, z_score double, "
                  "iqr_factor double, method string, severity string, description string, scan string")


def ingest_anomaly_state(spark: SparkSession, sf_dir: str, root: str, max_files_per_trigger: int = 1) -> None:
    """O2, state: the stream's value counts and rows under ``root``.  A row belongs to the hour that ends at or
    after it, as windows of the job leave out their start and hold their end.  Each micro-batch writes folders of
    its own, anew if it is repeated."""
    from ..config import METRICS
    from ..plans.common import to_long
    from ..session import pin_utc

    pin_utc(spark)

    def sink(batch: DataFrame, epoch: int) -> None:
        rows = _aq_from_events(batch).persist()
        try:
            hour = F.date_trunc("hour", F.col("observed_at") - F.expr("INTERVAL 1 MICROSECOND")) + F.expr("INTERVAL 1 HOUR")
            counts = to_long(rows.withColumn("hour", hour), ["hour", "station_id"], METRICS).groupBy(
                "hour", "station_id", "metric", "value").agg(F.count(F.lit(1)).alias("n"))
            counts.write.mode("overwrite").parquet(f"{root}/counts/epoch={epoch}")
            rows.withColumn("day", F.to_date("observed_at")).write.mode("overwrite").partitionBy("day").parquet(f"{root}/rows/epoch={epoch}")
        finally:
            rows.unpersist()

    _run(events_stream(spark, sf_dir, max_files_per_trigger).writeStream.foreachBatch(sink), root)


def scan_anomalies(spark: SparkSession, root: str, stations: DataFrame, as_of: datetime, scan_hours: float = 24) -> DataFrame:
    """O2, job: anomalies of the last hours against the counts of 7 days, suppressed against those of earlier
    scans; they are stored as this scan's (anew if it is repeated) and returned.  ``as_of`` is a whole hour."""
    from ..config import ANOMALY_HISTORY_DAYS
    from ..plans.anomaly import detect_anomalies, metric_stats_of_counts
    from ..sources.binding import ts_lit

    if as_of != as_of.replace(minute=0, second=0, microsecond=0):
        raise ValueError("as_of must be a whole hour")
    counts = spark.read.schema(COUNTS_SCHEMA).parquet(f"{root}/counts").where(
        (F.col("hour") > ts_lit(as_of - timedelta(days=ANOMALY_HISTORY_DAYS))) & (F.col("hour") <= ts_lit(as_of)))
    first_day = (as_of - timedelta(hours=scan_hours)).date()
    rows = spark.read.schema(ROWS_SCHEMA).parquet(f"{root}/rows").where(F.col("day").between(F.lit(first_day), F.lit(as_of.date())))
    scan = as_of.strftime("%Y%m%d%H")
    found = read_anomalies(spark, root)
    prior = found.where(F.col("scan") < scan) if found is not None else None
    stats = metric_stats_of_counts(counts, stations)
    new = detect_anomalies(rows, stations, as_of, scan_hours=scan_hours, prior=prior, stats=stats)
    new.write.mode("overwrite").parquet(f"{root}/anomalies/scan={scan}")
    return spark.read.schema(new.schema).parquet(f"{root}/anomalies/scan={scan}")


def read_anomalies(spark: SparkSession, root: str) -> DataFrame | None:
    """Anomalies of all scans (None before the first)."""
    table = f"{root}/anomalies"
    return spark.read.schema(ANOMALY_SCHEMA).parquet(table) if _table_exists(spark, table) else None


def stream_anomalies(spark: SparkSession, sf_dir: str, as_of: datetime, scan_hours: float = 24) -> DataFrame:
    """O2: the whole stream, then one scan."""
    from ..sources.binding import Bound

    root = stream_root(spark, "anomalies")
    ingest_anomaly_state(spark, sf_dir, root)
    return scan_anomalies(spark, root, Bound(spark, sf_dir).stations, as_of, scan_hours)


# --- O2, stateful form ------------------------------------------------------------------
SUPPRESS_US = 3600 * 1_000_000  # one hour in microseconds
STATEFUL_OUTPUT = ("station_id int, metric string, obs_id long, det_us long, value double, z double, f double, "
                   "method string")


def suppress_in_order(last_us, det_us, obs_ids):
    """Keep a candidate unless the last *emitted* one of its key lies within the hour before it
    (no upper bound, as C18).  Rows are taken in (time, id) order; returns (keep mask, new last)."""
    order = sorted(range(len(det_us)), key=lambda i: (det_us[i], obs_ids[i]))
    keep = [False] * len(det_us)
    for i in order:
        t = int(det_us[i])
        if last_us is None or not (last_us > t - SUPPRESS_US):
            keep[i] = True
            last_us = t if last_us is None else max(last_us, t)
    return keep, last_us


def _suppress_group(key, pdfs, state):
    import pandas as pd

    last = int(state.get[0]) if state.exists else None
    kept = []
    for pdf in pdfs:
        mask, last = suppress_in_order(last, pdf["det_us"].tolist(), pdf["obs_id"].tolist())
        kept.append(pdf[mask])
    if last is not None:
        state.update((int(last),))
    cols = [c.strip().split(" ")[0] for c in STATEFUL_OUTPUT.split(",")]
    yield pd.concat(kept)[cols] if kept else pd.DataFrame(columns=cols)


def stream_anomalies_stateful(spark: SparkSession, sf_dir: str, as_of: datetime, scan_hours: float = 24) -> DataFrame:
    """O2 with keyed state: candidates from a stream-static join against the 7-day stats are
    suppressed per (station, metric) by ``applyInPandasWithState`` holding the last emitted
    time.  Unlike the batch job, emissions of the same micro-batch also suppress each other
    (SURVEY T5).  Each group's input is the candidates of one key: anomalies, few by nature."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    from ..plans.anomaly import metric_stats, score_candidates
    from ..plans.common import to_long, window
    from ..session import pin_utc
    from ..sources.binding import Bound

    pin_utc(spark)
    root = stream_root(spark, "anomalies-stateful")
    table = f"{root}/anomalies"
    b = Bound(spark, sf_dir)
    stats = metric_stats(b.aq, b.stations, as_of)  # static side of the stream-static join
    recent = to_long(window(_aq_from_events(events_stream(spark, sf_dir)), as_of, hours=scan_hours),
                     ["station_id", "observed_at", "obs_id"])
    cand = score_candidates(recent, stats).withColumn("det_us", F.unix_micros(F.col("detected_at").cast("timestamp")))
    cand = cand.select("station_id", "metric", "obs_id", "det_us", "value", "z", "f", "method")
    out = cand.groupBy("station_id", "metric").applyInPandasWithState(
        _suppress_group, STATEFUL_OUTPUT, "last_us long", "append", GroupStateTimeout.NoTimeout)
    q = (out.writeStream.format("parquet").option("path", table).option("checkpointLocation", f"{root}/_checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    res = spark.read.schema(STATEFUL_OUTPUT).parquet(table)
    return res.select("station_id", "metric", "obs_id", F.timestamp_micros("det_us").alias("detected_at"), "value",
                      F.bround("z", 3).alias("z_score"), F.bround("f", 3).alias("iqr_factor"), "method")
