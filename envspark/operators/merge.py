"""Keyed writes on immutable files.

Plain Parquet has no MERGE; an upsert is ``existing UNION new`` reduced to the
newest version per key (an aggregate: map-side combine, skew-safe), written with
dynamic partition overwrite so only touched partitions are rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest_per_key


def latest_version(df: DataFrame, keys: Sequence[str], version_cols: Sequence[str | Column]) -> DataFrame:
    """One row per key: the greatest ``version_cols`` tuple (a later write wins)."""
    return latest_per_key(df, keys, version_cols, [c for c in df.columns if c not in keys]).select(*df.columns)


def keyed_merge(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``INSERT ... ON CONFLICT (keys) DO UPDATE`` — new rows replace existing rows with
    the same key; within ``new`` the last row (highest ``_seq`` if present) wins."""
    cols = existing.columns
    e = existing.select(*cols, F.lit(0).alias("_src"), F.lit(0).cast("long").alias("_seq"))
    seq = F.col("_seq") if "_seq" in new.columns else F.lit(0).cast("long")
    n = new.select(*cols, F.lit(1).alias("_src"), seq.alias("_seq"))
    return latest_version(e.unionByName(n), keys, ["_src", "_seq"]).select(*cols)


def keyed_update(target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``UPDATE target SET columns = updates.columns WHERE key matches`` (others untouched)."""
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in columns], F.lit(True).alias("_hit"))
    j = target.join(u, list(keys), "left")
    out = [F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
           for c in target.columns]
    return j.select(*out)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``ON CONFLICT DO NOTHING`` — rows of ``new`` whose key is absent (first per key wins)."""
    fresh = new.join(existing.select(*keys), list(keys), "left_anti")
    return fresh.dropDuplicates(list(keys))


def cascade_delete(children: DataFrame, surviving_parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """Keep only children whose parent survives."""
    return children.join(surviving_parents.select(F.col(pk).alias(fk)), fk, "left_semi")


def write_partitioned_upsert(df: DataFrame, path: str, partition_cols: Sequence[str]) -> None:
    """Write with dynamic partition overwrite: only partitions present in ``df`` are replaced."""
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.write.mode("overwrite").partitionBy(*partition_cols).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def insert_ignore_ordered(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """N3 with a deterministic winner inside ``new``: the first row by ``order`` per absent key."""
    fresh = new.join(existing.select(*keys), list(keys), "left_anti")
    first = F.min_by(F.struct(*[F.col(c) for c in fresh.columns if c not in keys]), F.struct(*[F.col(c) for c in order]))
    return fresh.groupBy(*keys).agg(first.alias("_f")).select(*keys, "_f.*").select(*fresh.columns)
