"""Domain / range validation (B8): DDL CHECK constraints as a rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES — CHECK constraints of the observation tables: (table, rule, column, lo, hi)
RULES = [
    ("air_quality", "aqi_non_negative", "aqi", 0, None),
    ("air_quality", "pm25_non_negative", "pm25", 0, None),
    ("air_quality", "pm10_non_negative", "pm10", 0, None),
    ("air_quality", "o3_non_negative", "o3", 0, None),
    ("air_quality", "no2_non_negative", "no2", 0, None),
    ("air_quality", "so2_non_negative", "so2", 0, None),
    ("air_quality", "co_non_negative", "co", 0, None),
    ("weather", "humidity_0_100", "humidity_pct", 0, 100),
    ("weather", "wind_speed_non_negative", "wind_speed_mps", 0, None),
    ("weather", "cloud_cover_0_100", "cloud_cover_pct", 0, 100),
]


def rule_violations(df: DataFrame, table: str, id_col: str = "obs_id") -> DataFrame:
    """Rows (id, table, rule, value) that break a rule; NULL values pass (CHECK semantics)."""
    parts = []
    for t, rule, col, lo, hi in RULES:
        if t != table or col not in df.columns:
            continue
        v = F.col(col).cast("double")
        bad = v < lo if hi is None else (v < lo) | (v > hi)
        parts.append(df.filter(bad).select(F.col(id_col).alias("id"), F.lit(t).alias("table_name"), F.lit(rule).alias("rule"), v.alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_report(df: DataFrame, table: str) -> DataFrame:
    """Per rule: rows checked (non-NULL), passed and failed — one aggregate pass."""
    aggs, names = [], []
    for t, rule, col, lo, hi in RULES:
        if t != table or col not in df.columns:
            continue
        v = F.col(col).cast("double")
        bad = v < lo if hi is None else (v < lo) | (v > hi)
        aggs += [F.count(v).alias(f"{rule}__checked"), F.count(F.when(bad, 1)).alias(f"{rule}__failed")]
        names.append(rule)
    row = df.agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(n).alias("rule"), F.col(f"{n}__checked").alias("checked"),
                 F.col(f"{n}__failed").alias("failed")) for n in names]))
    return row.select(stack.alias("r")).select("r.*").withColumn("passed", F.col("checked") - F.col("failed"))
