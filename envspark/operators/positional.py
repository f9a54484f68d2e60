"""Distributed ranks and running totals.

``row_number() OVER (PARTITION BY key ORDER BY t)`` sorts a whole key in one
task.  Here rows are dealt into ranges of (key, order), so a hot key takes as many
ranges as its rows need, however they lie in time; each range gives every key it
holds one total, and the totals of the ranges before it are the offset of its rows.
The window that numbers rows therefore runs inside one (range, key) slice, and the
table of totals has one row per range and key met there.  The dealt rows are
checkpointed, as ranges come from a sample: both readers must see the same cut, and
a task that runs again after an executor loss reads the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of one range, about; sessions with more shuffle partitions get smaller ranges.
ROWS_PER_RANGE = 1_000_000


def running_total(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], weight: Column | None = None, out: str = "before") -> DataFrame:
    """Add ``out``: the sum of ``weight`` (None: number) of the key's rows that come before each row in ``order_by``,
    which must make the order total within the key.  Null keys are keys, nulls order first."""
    keys, order_by = list(keys), list(order_by)
    rows = df.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
    ranges = max(-(-rows.count() // ROWS_PER_RANGE), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut_lineage(rows.repartitionByRange(ranges, *keys, *order_by).withColumn("_range", F.spark_partition_id()))
    # one number for each key, so that keys join as values and a null key finds itself
    slice_ = [F.coalesce(F.to_json(F.struct(*keys)), F.lit("")).alias("_key"), "_range"]
    totals = dealt.groupBy(*slice_).agg(F.sum("_w").alias("_total"))
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_key", "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_key", "_range").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select(*df.columns, "_w", *slice_).withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    joined = local.join(offsets, ["_key", "_range"])
    return joined.select(*df.columns, (F.col("_offset") + F.col("_local")).alias(out))


def positional_index(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], out: str = "pos") -> DataFrame:
    """Add ``out`` = 0-based position of each row within its key, ordered by ``order_by``
    (which must make the order total, e.g. end with a unique id)."""
    return running_total(df, keys, order_by, None, out)


def exact_percentiles(values: DataFrame, keys: Sequence[str], value: str, levels: dict[str, float], weight: Column | None = None) -> DataFrame:
    """(keys..., one column per level): interpolated percentiles of ``value`` per key, exact; a row stands for
    ``weight`` equal ones (None: one).

    Rows shrink to (key, value, count) first; the two order statistics beside each position are then the
    values whose running count covers it.  No task holds the values of a key."""
    keys = list(keys)
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    placed = running_total(counts, keys, ["_v"], F.col("_n"), "_from")
    sizes = placed.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    wanted = F.array(*[F.struct(F.lit(k).alias("level"), ((F.col("_size") - 1) * F.lit(p)).alias("at")) for k, p in enumerate(levels.values())])
    # few rows per key: the positions asked for
    asked = sizes.select(*keys, F.explode(wanted).alias("_q")).select(*keys, "_q.level", "_q.at")
    covers = lambda place: (F.col("_from") <= place) & (place < F.col("_from") + F.col("_n"))
    # a value count meets its key's positions: as many as there are levels, so the join does not fan out beyond them
    at = asked.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.array_sort(F.collect_list(F.struct("level", "at"))).alias("_asked"))
    met = placed.join(at, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])
    out = []
    for k, name in enumerate(levels):
        place = F.col("_asked")[k]["at"]
        low = F.max(F.when(covers(F.floor(place)), F.col("_v")))
        high = F.max(F.when(covers(F.ceil(place)), F.col("_v")))
        first = F.max(place)
        mixed = (F.ceil(first) - first) * low + (first - F.floor(first)) * high
        out.append(F.when(F.floor(first) == F.ceil(first), low).otherwise(F.when(low == high, low).otherwise(mixed)).cast("double").alias(name))
    return met.groupBy(*keys).agg(*out)
