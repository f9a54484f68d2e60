"""Joins of a fact with a dimension on keys of few values (station, provider, endpoint)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions of up to so many rows are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_ROWS = 100_000


def attach(fact: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``fact`` joined with ``dim`` on ``key``.  A key of few values would send a third of the fact to
    one task if it were shuffled, so the dimension is broadcast after its rows were counted (the
    count stops behind the bound); a larger one has many keys and is joined by a shuffle."""
    small = dim.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return fact.join(F.broadcast(dim) if small else dim, key, how)
