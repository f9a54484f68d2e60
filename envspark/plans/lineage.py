"""Lineage views (L2, L4, L7, L8) over the lineage tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..operators import latest_per_key
from ..operators.dimension import attach
from ..sources import lineage as LT
from ..sources.binding import ts_lit
from .common import until


def pipeline_run_overview(aq: DataFrame) -> DataFrame:
    """L2: runs of known pipelines with their definition, endpoint, error summary and metrics."""
    landed = LT.payloads(aq)
    definitions = LT.pipeline_definitions(landed).select("pipeline_code", "pipeline_name", "pipeline_type")
    ep = LT.endpoints(landed).select("endpoint_code", "endpoint_name")
    runs = attach(attach(LT.pipeline_runs(landed), definitions, "pipeline_code", "inner"), ep, "endpoint_code")
    return runs.select(
        F.col("pipeline_run_id").alias("id"), "pipeline_code", "pipeline_name", "pipeline_type", "status", "trigger_type", "started_at",
        "finished_at", "endpoint_code", "endpoint_name", "records", "error_summary", "metrics")


def observation_full_lineage(aq: DataFrame, stations: DataFrame) -> DataFrame:
    """L4: every observation of a known station with provider, endpoint, run, the newest request of
    its run and endpoint, and normalize run."""
    st = stations.select("station_id", F.col("code").alias("station_code"))
    landed = LT.payloads(aq)
    ep = LT.endpoints(landed)
    pv = ep.select("provider_code", F.upper("provider_code").alias("provider_name")).distinct()
    ep = ep.select("endpoint_code", "endpoint_name")
    run = LT.pipeline_runs(landed).select("pipeline_run_id", F.col("status").alias("run_status"), F.col("started_at").alias("run_started_at"))
    req = latest_per_key(LT.outbound_requests(landed), ["pipeline_run_id", "endpoint_code"], ["request_started_at", "request_id"],
                         ["request_id", "status", "http_status", "latency_ms"]).withColumnRenamed("status", "request_status")
    nr = LT.normalize_runs(landed).select("normalize_run_id", "parser_key", "parser_version")
    o = aq.select("obs_id", "station_id", "observed_at", "fetched_at", "aqi", "provider_code", "endpoint_code", "pipeline_run_id",
                  "raw_payload_id", "normalize_run_id")
    o = attach(attach(attach(o, st, "station_id", "inner"), pv, "provider_code"), ep, "endpoint_code")
    return (o.join(run, "pipeline_run_id", "left").join(req, ["pipeline_run_id", "endpoint_code"], "left")
            .join(nr, "normalize_run_id", "left"))


def station_bindings_overview(aq: DataFrame, stations: DataFrame, as_of: datetime) -> DataFrame:
    """Stations x their bindings with endpoint/provider and the binding's latest observation."""
    s = stations.select("station_id", F.col("code").alias("station_code"), F.col("is_active").alias("station_active"))
    landed = LT.payloads(aq)
    b = LT.bindings(landed)
    ep = LT.endpoints(landed).select("endpoint_code", "provider_code", "endpoint_name", F.col("kind").alias("endpoint_kind"))
    last = latest_per_key(until(aq, as_of), ["station_id", "endpoint_code"], ["observed_at", "obs_id"], ["observed_at", "aqi"])
    return (s.join(b, "station_id", "left").join(ep, "endpoint_code", "left")
            .join(last.withColumnRenamed("observed_at", "latest_observation_at").withColumnRenamed("aqi", "latest_aqi"),
                  ["station_id", "endpoint_code"], "left")
            .select("station_id", "station_code", "station_active", "binding_id", "external_object_id", "priority",
                    F.col("is_enabled").alias("binding_enabled"), "valid_from", "provider_code", "endpoint_code", "endpoint_name",
                    "endpoint_kind", "latest_observation_at", "latest_aqi"))


def provider_health(aq: DataFrame, as_of: datetime) -> DataFrame:
    """24 h request stats per provider (count-bug guarded), p95 latency, success rate,
    active bindings and last success."""
    landed = LT.payloads(aq)
    started, succeeded = F.col("request_started_at"), F.col("status") == "success"
    recent = (started > ts_lit(as_of - timedelta(hours=24))) & (started <= ts_lit(as_of))
    stats = LT.outbound_requests(landed).groupBy("provider_code").agg(
        F.count(F.when(recent, 1)).alias("total"), F.count(F.when(recent & succeeded, 1)).alias("ok"),
        F.count(F.when(recent & F.col("status").isin("failed", "timeout"), 1)).alias("bad"),
        round_half_up(F.avg(F.when(recent, F.col("latency_ms")))).cast("int").alias("avg_latency_ms"),
        round_half_up(F.percentile(F.when(recent, F.col("latency_ms")), F.lit(0.95))).cast("int").alias("p95_latency_ms"),
        F.sum(F.when(recent, F.col("response_size_bytes"))).alias("total_bytes_24h"),
        F.max(F.when(succeeded & (started <= ts_lit(as_of)), started)).alias("last_success_at"))
    act = LT.bindings(landed).filter("is_enabled").groupBy("endpoint_code").count().join(
        LT.endpoints(landed).select("endpoint_code", "provider_code"), "endpoint_code").groupBy("provider_code").agg(
        F.sum("count").alias("active_bindings"))
    j = LT.providers(landed).join(stats, "provider_code", "left").join(act, "provider_code", "left")
    total = F.coalesce(F.col("total"), F.lit(0))
    return j.select(
        "provider_code", "provider_name", "is_active", total.alias("requests_24h"), F.coalesce("ok", F.lit(0)).alias("success_24h"),
        F.coalesce("bad", F.lit(0)).alias("failed_24h"),
        F.when(total > 0, round_half_up(F.col("ok") / total * 100, 1)).otherwise(F.lit(0.0)).alias("success_rate_pct"),
        "avg_latency_ms", "p95_latency_ms", "total_bytes_24h", F.coalesce("active_bindings", F.lit(0)).alias("active_bindings"),
        "last_success_at",
    )


def analysis_run_lineage(aq: DataFrame, stations: DataFrame, summaries: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One daily-summary analysis run per station-day, with the pipeline run that last fed
    it and its output counts (correlated COUNT subqueries as group-by + left join + coalesce)."""
    day = F.to_date("observed_at")
    feed = aq.groupBy("station_id", day.alias("period_from")).agg(
        F.max_by("pipeline_run_id", F.struct("fetched_at", "obs_id")).alias("pipeline_run_id"))
    runs = summaries.select("station_id", F.col("summary_date").alias("period_from")).join(feed, ["station_id", "period_from"])
    run_id = F.concat_ws("-", F.lit("daily"), F.col("station_id").cast("string"), F.col("period_from").cast("string"))
    runs = runs.withColumn("analysis_run_id", run_id)
    n_sum = summaries.groupBy("station_id", F.col("summary_date").alias("period_from")).agg(F.count(F.lit(1)).alias("daily_summaries_count"))
    n_anom = anomalies.groupBy("station_id", F.to_date("detected_at").alias("period_from")).agg(F.count(F.lit(1)).alias("anomalies_found"))
    pr = LT.pipeline_runs(LT.payloads(aq)).select("pipeline_run_id", "pipeline_code", F.col("status").alias("pipeline_status"),
                                     F.col("started_at").alias("pipeline_started_at"), F.col("finished_at").alias("pipeline_finished_at"))
    st = stations.select("station_id", F.col("code").alias("station_code"))
    j = (runs.join(st, "station_id", "left").join(pr, "pipeline_run_id")
         .join(n_sum, ["station_id", "period_from"], "left").join(n_anom, ["station_id", "period_from"], "left"))
    return j.select(
        "analysis_run_id", F.lit("daily_summary").alias("analysis_type"), F.lit("daily_summary").alias("algorithm_key"),
        F.lit("1").alias("algorithm_version"), "station_id", "station_code", "period_from",
        F.date_add("period_from", 1).alias("period_to"), F.lit("success").alias("analysis_status"),
        "pipeline_run_id", "pipeline_code", "pipeline_status", "pipeline_started_at", "pipeline_finished_at",
        F.coalesce("daily_summaries_count", F.lit(0)).alias("daily_summaries_count"),
        F.coalesce("anomalies_found", F.lit(0)).alias("anomalies_found"), F.lit(0).alias("reports_generated"),
    )
