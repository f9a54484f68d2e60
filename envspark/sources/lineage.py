"""Ingest lineage tables derived from the observation rows (providers, endpoints,
bindings, outbound requests, pipeline definitions and runs, normalize runs).

Each air-quality row carries the ids of the run, raw payload and normalize run
that produced it (see ``binding.lineage_columns``).  ``payloads`` groups the rows by
these ids once; the other tables are groups of payloads, so they grow with the data
like the real ones and the observations are read no second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# FIXED VALUES — binding priority per provider (model data first, rate-limited network second)
PROVIDER_PRIORITY = {"openmeteo": 100, "waqi": 200}


def payloads(aq: DataFrame) -> DataFrame:
    """One row per raw payload (run x station), landed in the shared checkpoint folder."""
    ids = ["raw_payload_id", "station_id", "pipeline_run_id", "normalize_run_id", "provider_code", "endpoint_code"]
    return cut_lineage(aq.groupBy(*ids).agg(
        F.min("fetched_at").alias("fetched_at"), F.min("observed_at").alias("observed_at"), F.count(F.lit(1)).alias("records"),
        F.count("aqi").alias("known"), F.min("obs_id").alias("first_id"), F.sum("obs_id").alias("id_sum")))


def providers(landed: DataFrame) -> DataFrame:
    p = landed.select("provider_code").distinct()
    return p.select(F.col("provider_code"), F.upper("provider_code").alias("provider_name"), F.lit(True).alias("is_active"))


def endpoints(landed: DataFrame) -> DataFrame:
    e = landed.select("endpoint_code", "provider_code").distinct()
    return e.select("endpoint_code", "provider_code", F.concat(F.upper("provider_code"), F.lit(" hourly")).alias("endpoint_name"),
                    F.lit("api").alias("kind"), F.lit("0 * * * *").alias("schedule_expression"), F.lit(True).alias("is_active"))


def bindings(landed: DataFrame) -> DataFrame:
    prio = F.when(F.col("provider_code") == "waqi", F.lit(PROVIDER_PRIORITY["waqi"])).otherwise(F.lit(PROVIDER_PRIORITY["openmeteo"]))
    b = landed.groupBy("station_id", "endpoint_code", "provider_code").agg(F.min("observed_at").alias("valid_from"))
    return b.select(
        F.concat_ws(":", F.col("station_id").cast("string"), "endpoint_code").alias("binding_id"), "station_id", "endpoint_code",
        F.concat(F.lit("ext-"), F.col("station_id").cast("string")).alias("external_object_id"), prio.alias("priority"),
        F.lit(True).alias("is_enabled"), "valid_from", F.lit(None).cast("timestamp_ntz").alias("valid_to"),
    )


def outbound_requests(landed: DataFrame) -> DataFrame:
    """One request per raw payload."""
    status = F.when(F.col("first_id") % 17 == 0, F.lit("failed")).when(F.col("first_id") % 29 == 0, F.lit("timeout")).otherwise(F.lit("success"))
    return landed.select(
        F.col("raw_payload_id").alias("request_id"), "pipeline_run_id", "provider_code", "endpoint_code", status.alias("status"),
        F.when(status == "success", F.lit(200)).otherwise(F.lit(500)).alias("http_status"),
        (F.pmod(F.col("id_sum"), F.lit(997)) + 20).cast("int").alias("latency_ms"),
        (F.col("records") * 512).cast("int").alias("response_size_bytes"), F.col("fetched_at").alias("request_started_at"), "records",
    )


def pipeline_definitions(landed: DataFrame) -> DataFrame:
    """One ingest pipeline per provider."""
    p = landed.select("provider_code").distinct()
    return p.select(F.concat("provider_code", F.lit("_ingest")).alias("pipeline_code"), F.concat(F.upper("provider_code"), F.lit(" ingest")).alias("pipeline_name"),
                    F.lit("ingest").alias("pipeline_type"), F.lit(True).alias("is_active"))


def pipeline_runs(landed: DataFrame) -> DataFrame:
    """Runs with what went wrong (null if nothing did) and their counts as JSON."""
    g = outbound_requests(landed).groupBy("pipeline_run_id", "provider_code", "endpoint_code").agg(
        F.min("request_started_at").alias("started_at"), F.max("request_started_at").alias("finished_at"),
        F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("status") != "success", 1)).alias("failed_requests"),
        F.sum("records").alias("records"))
    return g.select(
        "pipeline_run_id", F.concat("provider_code", F.lit("_ingest")).alias("pipeline_code"), "provider_code", "endpoint_code",
        F.when(F.col("failed_requests") == 0, F.lit("success")).when(F.col("failed_requests") < F.col("requests"), F.lit("partial"))
        .otherwise(F.lit("failed")).alias("status"),
        F.lit("schedule").alias("trigger_type"), "started_at", "finished_at", "requests", "failed_requests", "records",
        F.when(F.col("failed_requests") > 0, F.format_string("%d of %d requests failed", "failed_requests", "requests")).alias("error_summary"),
        F.to_json(F.struct("requests", "failed_requests", "records")).alias("metrics"),
    )


def normalize_runs(landed: DataFrame) -> DataFrame:
    g = landed.groupBy("normalize_run_id", "pipeline_run_id").agg(F.sum("records").alias("records_in"), F.sum("known").alias("records_out"))
    return g.select("normalize_run_id", "pipeline_run_id", F.lit("aq_v1").alias("parser_key"), F.lit("1.0").alias("parser_version"),
                    F.lit("success").alias("status"), "records_in", "records_out")
