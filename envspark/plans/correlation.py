"""I4 — correlation matrix over 30 days per active station.

AQ-AQ: 21 pairs, pairwise-complete Pearson.  AQ-weather: 7 x 3 pairs, either
*positional* (i-th AQ row with i-th weather row, the replaced service's
behaviour, trap T4) or *hour-aligned* (hourly means joined on station-hour).
Every pair is computed from population moments in one grouped aggregate over a
long (pair, a, b) form; a pair needs >= 10 clean rows and non-zero spread.  The
explode feeds the partial aggregate inside one code-generated stage, so the pair
rows are never shuffled or stored; a single wide aggregate (4 moments x 42 pairs)
was measured slower because its ~230 buffer fields exceed the codegen field limit.
"""

from __future__ import annotations

from datetime import datetime
from itertools import combinations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CORRELATION_DAYS, CORRELATION_MIN_PAIRS, CORRELATION_MIN_ROWS, METRICS, WEATHER_LABELS, WEATHER_METRICS
from ..operators.positional import positional_index
from .common import active_only, window


def _pairs_long(df: DataFrame, keys: list[str], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """(keys..., metric_a, metric_b, category, a, b) for every pair, rows with a or b NULL dropped."""
    arr = F.array(*[
        F.struct(F.lit(la).alias("metric_a"), F.lit(lb).alias("metric_b"), F.lit(cat).alias("category"),
                 F.col(ca).cast("double").alias("a"), F.col(cb).cast("double").alias("b"))
        for ca, cb, la, lb, cat in pairs
    ])
    return df.select(*keys, F.explode(arr).alias("p")).select(*keys, "p.*").filter(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )


ROWS = "__rows__"  # pseudo pair (1.0, 1.0): its count is the number of rows per station


def _moments(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys, "metric_a", "metric_b", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop("a", "b").alias("cov"),
        F.stddev_pop("a").alias("sa"),
        F.stddev_pop("b").alias("sb"),
        # exact constancy test: merged floating moments of a constant column can be ~1e-16, not 0
        (F.min("a") < F.max("a")).alias("va"),
        (F.min("b") < F.max("b")).alias("vb"),
    )


def _pearson(g: DataFrame, keys: list[str]) -> DataFrame:
    g = g.filter((F.col("category") != ROWS) & (F.col("n") >= CORRELATION_MIN_PAIRS) & F.col("va") & F.col("vb"))
    return g.select(*keys, "metric_a", "metric_b", "category",
                    F.bround(F.try_divide(F.col("cov"), F.col("sa") * F.col("sb")), 4).alias("correlation"),
                    F.col("n").alias("pairs"))


def _row_gate(counts: DataFrame, col: str, out: str) -> DataFrame:
    return counts.groupBy("station_id").agg(F.sum(col).alias(out)).filter(F.col(out) >= CORRELATION_MIN_ROWS)


def correlation_matrix(aq: DataFrame, wx: DataFrame, stations: DataFrame, as_of: datetime,
                       positional: bool = False, parts: tuple[str, ...] = ("aq_aq", "aq_weather")) -> DataFrame:
    """Rows: station_id, metric_a, metric_b, category, correlation, pairs, sample_size.

    ``parts`` selects the AQ-AQ and/or AQ-weather blocks, so a caller that needs one block
    does not scan for the other.  Row-count gates come out of the same aggregates as the
    moments (a pseudo pair for AQ-AQ, per-hour counts for the hour-aligned join)."""
    aq_w = active_only(window(aq, as_of, days=CORRELATION_DAYS), stations)
    wx_w = active_only(window(wx, as_of, days=CORRELATION_DAYS), stations)
    blocks, aq_n = [], None

    if "aq_aq" in parts:
        aa_pairs = [(a, b, a, b, "aq_aq") for a, b in combinations(METRICS, 2)] + [("_one", "_one", ROWS, ROWS, ROWS)]
        g = _moments(_pairs_long(aq_w.withColumn("_one", F.lit(1.0)), ["station_id"], aa_pairs), ["station_id"])
        g = g.persist(StorageLevel.MEMORY_AND_DISK)  # 22 rows per station, read by two branches
        aq_n = g.filter(F.col("category") == ROWS).select("station_id", F.col("n").alias("sample_size")).filter(
            F.col("sample_size") >= CORRELATION_MIN_ROWS)
        blocks.append(_pearson(g, ["station_id"]))

    if "aq_weather" in parts:
        aw_pairs = [(a, w, a, WEATHER_LABELS[w], "aq_weather") for a in METRICS for w in WEATHER_METRICS]
        if positional:
            a_idx = positional_index(aq_w.select("station_id", "observed_at", "obs_id", *METRICS), ["station_id"], ["observed_at", "obs_id"])
            w_idx = positional_index(wx_w.select("station_id", "observed_at", "obs_id", *WEATHER_METRICS), ["station_id"], ["observed_at", "obs_id"])
            zipped = a_idx.drop("observed_at", "obs_id").join(w_idx.drop("observed_at", "obs_id"), ["station_id", "pos"])
            wx_n = _row_gate(wx_w.withColumn("_c", F.lit(1)), "_c", "_nw")
            if aq_n is None:
                aq_n = _row_gate(aq_w.withColumn("_c", F.lit(1)), "_c", "sample_size")
        else:
            hour = F.date_trunc("hour", "observed_at").alias("hour")
            ah = aq_w.groupBy("station_id", hour).agg(*[F.avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("_ca"))
            wh = wx_w.groupBy("station_id", hour).agg(*[F.avg(m).alias(m) for m in WEATHER_METRICS], F.count(F.lit(1)).alias("_cw"))
            wx_n = _row_gate(wh, "_cw", "_nw")
            if aq_n is None:
                aq_n = _row_gate(ah, "_ca", "sample_size")
            zipped = ah.join(wh, ["station_id", "hour"])
        g = _moments(_pairs_long(zipped.join(wx_n, "station_id", "left_semi"), ["station_id"], aw_pairs), ["station_id"])
        blocks.append(_pearson(g, ["station_id"]))

    out = blocks[0]
    for blk in blocks[1:]:
        out = out.unionByName(blk)
    return out.join(aq_n, "station_id")
