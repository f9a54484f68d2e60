"""Spatial joins without Cartesian products.

Cells have 360 / n degrees with a whole number n of them around the globe, so longitudes wrap at
+-180 by a modulo.

``within_km_join``: each right-side point is exploded into the cells its radius-``km`` disc can
touch (the bounding box widens with 1/cos(lat) and is the whole circle at a pole, so it is exact
at any latitude); left points carry their own cell; the equi-join on cell is followed by the
exact haversine predicate.  Work is proportional to the number of true neighbours, not |left| x |right|.

``knn_join``: k nearest right points per left point, with one candidate join.  A pyramid of counts (cells
of 360 / 2**j degrees, each level summed from the one below) tells for each left cell the smallest
cell around it that holds k points; its diagonal bounds the k-th distance, so the cells
that a disc of that radius touches hold all k nearest, however far they are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..session import cut_lineage

KM_PER_DEG = 2 * math.pi * 6371.0 / 360.0  # 111.195 km per degree of latitude


#: Finest level of the pyramid (about 1 km) and levels below the one of average density.
FINEST, DENSER = 15, 2
#: Cells that a disc may touch along a parallel before a coarser level is probed.
MOST_ACROSS = 8


def _row(lat: Column, n) -> Column:
    """Cell row of a latitude, for ``n`` cells around the globe."""
    return F.floor((lat + 90.0) * n / 360.0).cast("long")


def _column(lng: Column, n) -> Column:
    return F.pmod(F.floor((lng + 180.0) * n / 360.0).cast("long"), n if isinstance(n, Column) else F.lit(n).cast("long"))


def _reach(lat: Column, km: Column | float) -> tuple[Column, Column]:
    """Degrees of latitude and of longitude that a disc of ``km`` around a point spans to each side."""
    km = km if isinstance(km, Column) else F.lit(float(km))
    dlat = km / F.lit(KM_PER_DEG)
    edge = F.abs(lat) + dlat
    # the meridians that touch a disc: asin(sin r / cos lat), the whole circle if it holds a pole
    ratio = F.sin(F.radians(F.least(dlat, F.lit(90.0)))) / F.cos(F.radians(lat))
    return dlat, F.when(edge >= 90.0, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9) + 1e-9)


def _touched(df: DataFrame, lat: Column, lng: Column, km: Column | float, n, row: str, column: str) -> DataFrame:
    """``df`` exploded into the cells (``row``, ``column``) that the ``km`` disc of each of its points can touch."""
    n_ = n if isinstance(n, Column) else F.lit(n)
    dlat, dlng = _reach(lat, km)
    rows = F.sequence(_row(F.greatest(lat - dlat, F.lit(-90.0)), n_), _row(F.least(lat + dlat, F.lit(90.0)), n_))
    west, east = (F.floor((lng + 180.0 + d) * n_ / 360.0).cast("long") for d in (-dlng, dlng))
    # each cell of the circle at most once
    columns = F.sequence(west, F.least(east, west + n_.cast("long") - 1))
    return df.withColumn(row, F.explode(rows)).withColumn(column, F.explode(columns)).withColumn(column, F.pmod(F.col(column), n_.cast("long")))


def within_km_join(
    left: DataFrame, right: DataFrame, km: float, *,
    left_latlng: tuple[str, str] = ("lat", "lng"), right_latlng: tuple[str, str] = ("lat", "lng"),
    cell_deg: float | None = None, strict: bool = True, dist_col: str = "dist_km",
) -> DataFrame:
    """Pairs (left row, right row) with haversine distance < km (<= km if not strict).
    Column names of the two sides must not collide except for the coordinates, which are
    renamed to l_lat/l_lng and r_lat/r_lng."""
    n = max(1, int(360.0 / (cell_deg or max(km / KM_PER_DEG, 0.01))))
    l = left.withColumnRenamed(left_latlng[0], "l_lat").withColumnRenamed(left_latlng[1], "l_lng")
    r = right.withColumnRenamed(right_latlng[0], "r_lat").withColumnRenamed(right_latlng[1], "r_lng")
    l = l.withColumn("_clat", _row(F.col("l_lat"), F.lit(n))).withColumn("_clng", _column(F.col("l_lng"), n))
    r = _touched(r, F.col("r_lat"), F.col("r_lng"), km, n, "_clat", "_clng")
    j = l.join(r, ["_clat", "_clng"]).drop("_clat", "_clng")
    d = haversine_km(F.col("l_lat"), F.col("l_lng"), F.col("r_lat"), F.col("r_lng"))
    j = j.withColumn(dist_col, d)
    return j.filter(F.col(dist_col) < km) if strict else j.filter(F.col(dist_col) <= km)


def auto_cell_deg(right: DataFrame, k: int, keys: Sequence[str]) -> float:
    """Starting probe cell from the data: twice the side of the square that holds k points
    at the average density of one partition key (one single-row aggregate)."""
    aggs = [F.min("lat"), F.max("lat"), F.min("lng"), F.max("lng"), F.count(F.lit(1))]
    if keys:
        aggs.append(F.approx_count_distinct(F.struct(*keys)))
    row = right.agg(*aggs).first()
    if not row or not row[4]:
        return 1.0
    n_keys = row[5] if keys else 1
    per_key = max(row[4] / max(n_keys or 1, 1), 1.0)
    area = max((row[1] - row[0]) * (row[3] - row[2]), 1e-4)
    return float(min(max(2.0 * math.sqrt(k * area / per_key), 0.01), 90.0))


def knn_join(
    left: DataFrame, right: DataFrame, k: int, *,
    left_id: str, right_id: str,
    partition_keys: Sequence[str] = (),
    exclude_self: bool = False,
    cell_deg: float | None = None,
    max_km: float | None = None,
    dist_col: str = "dist_km",
) -> DataFrame:
    """For each left row (lat, lng), the <= k nearest right rows (lat, lng) sharing
    ``partition_keys`` (e.g. the same hour), ranked 1..k by (distance, right id).

    ``cell_deg``: about the finest cell (None: from the average density, one aggregate).
    ``exclude_self`` drops pairs with equal ids; ``max_km`` bounds the distance.  Rows without
    coordinates have no neighbours.  Returns left columns, right columns prefixed ``r_``, ``dist_km`` and ``rank``."""
    keys = list(partition_keys)
    finest = min(FINEST, max(0, math.ceil(math.log2(360.0 / (cell_deg or auto_cell_deg(right, k, keys)))) + (0 if cell_deg else DENSER)))
    cell = [(_row(F.col("lat"), F.lit(2**finest))).alias("_y"), _column(F.col("lng"), 2**finest).alias("_x")]
    levels = F.sequence(F.lit(0), F.lit(finest))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(finest) - F.col("_j"))).cast("long")
    lifted = lambda df: df.withColumn("_j", F.explode(levels)).withColumn("_cy", up("_y")).withColumn("_cx", up("_x"))
    # the pyramid: counts of the finest cells, summed for each level above
    own = right.select(*keys, *cell).where("_y is not null and _x is not null").groupBy(*keys, "_y", "_x").agg(F.count(F.lit(1)).alias("_n"))
    counts = lifted(own).groupBy(*keys, "_j", "_cy", "_cx").agg(F.sum("_n").alias("_n"))
    # the smallest cell around each left cell that holds k points beside the point itself
    places = left.select(*keys, *cell).where("_y is not null and _x is not null").distinct()
    enough = lifted(places).join(counts.where(F.col("_n") >= k + int(exclude_self)), [*keys, "_j", "_cy", "_cx"])
    picked = enough.groupBy(*keys, "_y", "_x").agg(F.max("_j").alias("_level"))
    points = left.withColumn("_y", cell[0]).withColumn("_x", cell[1]).where("_y is not null and _x is not null")
    points = points.join(picked, [*keys, "_y", "_x"], "left").drop("_y", "_x")
    # its diagonal bounds the k-th distance; where not even the globe holds k, everything is near enough
    side = F.lit(360.0) / F.pow(F.lit(2.0), F.col("_level"))
    far = math.pi * 6371.0 * 1.001
    bound = F.coalesce(F.least(side * math.sqrt(2.0) * KM_PER_DEG * 1.001, F.lit(far)), F.lit(far))
    points = points.withColumn("_km", F.least(bound, F.lit(float(max_km))) if max_km is not None else bound)
    # a level at which the disc touches few cells, even beside a pole
    across = F.greatest(_reach(F.col("lat"), F.col("_km"))[1] / 180.0, F.col("_km") / (180.0 * KM_PER_DEG))
    level = F.least(F.coalesce("_level", F.lit(0)), F.floor(F.log2(F.lit(float(MOST_ACROSS)) / across)))
    points = cut_lineage(points.withColumn("_j", F.greatest(F.lit(0), level).cast("int")))
    used = sorted(r[0] for r in points.select("_j").distinct().collect())  # at most FINEST + 1 numbers
    probes = _touched(points, F.col("lat"), F.col("lng"), F.col("_km"), F.pow(F.lit(2.0), F.col("_j")).cast("long"), "_cy", "_cx")
    named = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    near = named.withColumn("_j", F.explode(F.array(*[F.lit(j) for j in used]))) if used else named.withColumn("_j", F.lit(0))
    width = F.pow(F.lit(2.0), F.col("_j")).cast("long")
    near = near.withColumn("_cy", _row(F.col("r_lat"), width)).withColumn("_cx", _column(F.col("r_lng"), width))
    found = probes.join(near, [*keys, "_j", "_cy", "_cx"])
    if exclude_self:
        found = found.filter(F.col(left_id) != F.col(f"r_{right_id}"))
    found = found.withColumn(dist_col, haversine_km(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))).where(F.col(dist_col) <= F.col("_km"))
    w = Window.partitionBy(*keys, left_id).orderBy(F.col(dist_col), F.col(f"r_{right_id}"))
    top = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    right_columns = [c for c in named.columns if c.startswith("r_") and c not in ("r_lat", "r_lng")]
    return top.select(*dict.fromkeys([*keys, *left.columns]), *right_columns, "r_lat", "r_lng", dist_col, "rank")
