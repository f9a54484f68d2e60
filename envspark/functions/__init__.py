"""Scalar column functions (JVM-side expressions, no Python UDFs)."""

from .aqi import (  # noqa: F401
    aqi_category, aqi_level, aqi_level_field, exposure_weight, pm25_to_aqi, freshness_status,
    trend_direction, anomaly_severity,
)
from .geo import haversine_km, idw_weight, cell_key  # noqa: F401
from .timefn import hour_sin, hour_cos, dow_sin, dow_cos, dow_sun0, dow_mon0, hours_between  # noqa: F401
from .numeric import py_round, confidence_from_mae  # noqa: F401
from .text import slugify_vi, weather_label  # noqa: F401
