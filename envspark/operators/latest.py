"""Latest-row and top-k-per-key operators.

``latest_per_key`` is an aggregate (``max_by`` over a struct ordering), not a
window: it combines map-side, so a key holding a third of the rows never lands
whole in one task.  ``top_k_per_key`` uses ``row_number() <= k``; Spark inserts a
partial ``WindowGroupLimit`` below the shuffle, so each key ships at most k rows
per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str | Column],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key: the row with the greatest ``order_by`` tuple (DESC NULLS LAST).

    Ties on the tuple are broken by the remaining columns in ``order_by``; pass a
    unique column last (e.g. an id) for a deterministic pick.
    """
    keys = list(keys)
    columns = [c for c in (columns or df.columns) if c not in keys]
    order = F.struct(*_cols(order_by))
    payload = F.struct(*[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(F.max_by(payload, order).alias("_latest")).select(*keys, "_latest.*")


def top_k_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    k: int,
    rank_col: str = "rn",
) -> DataFrame:
    """Rows ranked 1..k per key by ``order_by`` (ties broken by the given order only)."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
