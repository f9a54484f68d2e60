"""Fixed values that results depend on.

These are domain constants (EPA AQI bands, gates, model settings) that must be
identical to the service this engine replaces for results to agree.  They are
listed plainly, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — metric names
# ---------------------------------------------------------------------------
METRICS = ["aqi", "pm25", "pm10", "o3", "no2", "so2", "co"]
POLLUTANTS = ["pm25", "pm10", "o3", "no2", "so2", "co"]
WEATHER_METRICS = ["temperature_c", "humidity_pct", "wind_speed_mps"]
# weather label = column name with the unit suffixes "_c", "_pct", "_mps" removed
WEATHER_LABELS = {"temperature_c": "temperature", "humidity_pct": "humidity", "wind_speed_mps": "wind_speed"}

# ---------------------------------------------------------------------------
# FIXED VALUES — AQI category thresholds (upper bound inclusive -> label)
# ---------------------------------------------------------------------------
AQI_CATEGORY_THRESHOLDS = [
    (50, "good"),
    (100, "moderate"),
    (150, "unhealthy_sensitive"),
    (200, "unhealthy"),
    (300, "very_unhealthy"),
]
AQI_CATEGORY_ABOVE = "hazardous"
AQI_CATEGORY_NULL = "unknown"

# ---------------------------------------------------------------------------
# FIXED VALUES — AQI health levels: closed integer bands (min, max, label, risk,
# exposure weight, advice_vi, advice_en)
# ---------------------------------------------------------------------------
AQI_LEVELS = [
    (0, 50, "good", "low", 0,
     "Chất lượng không khí tốt. An toàn cho mọi hoạt động ngoài trời.",
     "Air quality is satisfactory. Safe for all outdoor activities."),
    (51, 100, "moderate", "low", 1,
     "Chấp nhận được. Nhóm nhạy cảm nên hạn chế hoạt động ngoài trời kéo dài.",
     "Acceptable. Sensitive groups should limit prolonged outdoor exertion."),
    (101, 150, "unhealthy_sensitive", "moderate", 2,
     "Không lành mạnh cho nhóm nhạy cảm. Trẻ em, người già, người bệnh hô hấp nên ở trong nhà.",
     "Unhealthy for sensitive groups. Children, elderly, and respiratory patients should stay indoors."),
    (151, 200, "unhealthy", "high", 4,
     "Không lành mạnh. Mọi người nên giảm hoạt động ngoài trời. Đeo khẩu trang khi ra ngoài.",
     "Unhealthy. Everyone should reduce outdoor activities. Wear masks outdoors."),
    (201, 300, "very_unhealthy", "very_high", 8,
     "Rất không lành mạnh. Tránh ra ngoài. Đóng cửa sổ, dùng máy lọc không khí.",
     "Very unhealthy. Avoid going outside. Close windows, use air purifiers."),
    (301, 500, "hazardous", "critical", 16,
     "Nguy hiểm! Ở trong nhà, không ra ngoài trừ trường hợp khẩn cấp.",
     "Hazardous! Stay indoors. Do not go outside except in emergencies."),
]
EXPOSURE_MAX_WEIGHT = 16

# ---------------------------------------------------------------------------
# FIXED VALUES — US EPA PM2.5 breakpoints (c_lo, c_hi, aqi_lo, aqi_hi)
# ---------------------------------------------------------------------------
PM25_BREAKPOINTS = [
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 500.4, 301, 500),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — job windows and minimum-sample gates
# ---------------------------------------------------------------------------
ANOMALY_HISTORY_DAYS = 7
ANOMALY_SCAN_HOURS = 2
ANOMALY_MIN_HISTORY = 10
ZSCORE_THRESHOLD = 3.0
IQR_FACTOR = 1.5
SUPPRESS_HOURS = 1

SEASONAL_DAYS = 30
SEASONAL_MIN_HOURS = 12

CORRELATION_DAYS = 30
CORRELATION_MIN_ROWS = 24
CORRELATION_MIN_PAIRS = 10

TREND_DAYS = 30
TREND_MIN_DAYS = 7
TREND_STABLE_PCT = 5

HEALTH_HOURS = 48
HEALTH_MIN_ROWS = 6

LINEAR_TRAIN_DAYS = 14
LINEAR_HORIZON_HOURS = 24
LINEAR_MIN_POINTS = 48
ARIMA_TRAIN_DAYS = 7
ARIMA_HORIZON_HOURS = 12
ARIMA_MIN_POINTS = 48
SEASONAL_FC_TRAIN_DAYS = 14
SEASONAL_FC_HORIZON_HOURS = 24
SEASONAL_FC_MIN_POINTS = 20
TRAIN_FRACTION = 0.8
EVAL_MIN_POINTS = 5

# ---------------------------------------------------------------------------
# FIXED VALUES — spatial fusion and grid
# ---------------------------------------------------------------------------
EARTH_RADIUS_KM = 6371.0
FUSION_MAX_DIST_KM = 30.0
FUSION_STATION_MAX_AGE_HOURS = 6
FUSION_GRID_MAX_AGE_HOURS = 24
FUSION_BASE_WEIGHT = 1.0
IDW_NUMERATOR = 3.0
IDW_NEAR_CAP = 100.0
IDW_NEAR_KM = 0.1
CONFIDENCE_DIVISOR = 3.0

GRID_LAT_MIN, GRID_LAT_MAX = 8.4, 23.6
GRID_LNG_MIN, GRID_LNG_MAX = 102.0, 110.0
GRID_STEP = 0.2

OPENMETEO_SOURCE = "openmeteo"
OPENMETEO_CONFIDENCE = 0.6
RASTER_SOURCE = "berkeley_earth"
RASTER_CONFIDENCE = 0.7
ML_SOURCE = "ml_predicted"
PAYLOAD_TZ = "Asia/Ho_Chi_Minh"

GRID_LATEST_MAX_AGE_HOURS = 12
FRESH_HOURS = 6
STALE_HOURS = 24

# ML
ML_TRAINING_DAYS = 30
ML_MIN_ROWS = 60
ML_KNN = 3
ML_INFERENCE_MAX_AGE_HOURS = 6
ML_PROMOTE_RATIO = 0.95
GBT_PARAMS = dict(maxIter=300, stepSize=0.06, maxDepth=6, minInstancesPerNode=15, seed=42, maxBins=256)

# Simple forecast view
SIMPLE_FORECAST_HOURS = 12
SIMPLE_FORECAST_LAG_ROW = 6
