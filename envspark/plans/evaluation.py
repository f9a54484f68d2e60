"""I7 / D13 — forecast evaluation: MAE, RMSE, MAPE per group.

NaN/NULL pairs are dropped, zero actuals are excluded from MAPE only, all values
round to 3 places, NULL when there is nothing to measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean(c):
    return F.when(~F.isnan(c), c)


def evaluate(df: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    a, p = clean(F.col(actual).cast("double")), clean(F.col(predicted).cast("double"))
    ok = a.isNotNull() & p.isNotNull()
    e = F.when(ok, a - p)
    rel = F.when(ok & (a != 0), F.abs((a - p) / a))
    g = df.groupBy(*keys).agg(
        F.count(e).alias("n"),
        F.avg(F.abs(e)).alias("_mae"),
        F.avg(e * e).alias("_mse"),
        F.avg(rel).alias("_mape"),
    )
    return g.select(
        *keys, "n",
        F.bround("_mae", 3).alias("mae"),
        F.bround(F.sqrt("_mse"), 3).alias("rmse"),
        F.bround(F.col("_mape") * 100, 3).alias("mape"),
    )
