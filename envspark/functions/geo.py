"""Spatial column functions (H5-H7, K5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_KM, IDW_NEAR_CAP, IDW_NEAR_KM, IDW_NUMERATOR


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """H5: great-circle distance in km (R = 6371)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi = F.radians(lat2 - lat1)
    dlmb = F.radians(lng2 - lng1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def idw_weight(dist_km: Column) -> Column:
    """H6: 100 when d < 0.1 km, else 3 / d^2."""
    return F.when(dist_km < IDW_NEAR_KM, F.lit(IDW_NEAR_CAP)).otherwise(F.lit(IDW_NUMERATOR) / (dist_km * dist_km))


def cell_key(coord: Column, cell_deg: float) -> Column:
    """K5: integer cell index of a coordinate for bucketed spatial joins."""
    return F.floor(coord / F.lit(cell_deg)).cast("long")
