"""DuckDB oracle SQL for the driver's correctness gate.

Each query is independent SQL over the driver's pre-registered views
(``events`` ...).  ``BINDING`` is the SQL twin of ``sources.binding``.
Conventions shared with the Spark side (see ``canon`` in __spark_entry__):
timestamps -> 'YYYY-MM-DD HH:MM:SS' strings, dates -> 'YYYY-MM-DD', integers ->
BIGINT, computed doubles rounded to <= 4 places.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

BINDING = """
obs_base AS (
  SELECT event_id AS obs_id, CAST(user_id % 12 AS INT) AS station_id, ts AS observed_at, event_type, value,
         TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k
  FROM events),
aq AS (
  SELECT obs_id, station_id, observed_at,
         CASE WHEN event_type = 'click' THEN 'waqi' ELSE 'openmeteo' END AS provider_code,
         CAST(floor(value) AS INT) AS aqi, value * 0.4 + k * 0.1 AS pm25, value * 0.8 + k * 0.2 AS pm10,
         CASE WHEN obs_id % 7 = 0 THEN NULL ELSE k END AS o3,
         CASE WHEN obs_id % 5 = 0 THEN NULL ELSE 100.0 - k + value * 0.05 END AS no2,
         CAST(obs_id % 23 AS DOUBLE) AS so2, CAST(3.5 AS DOUBLE) AS co,
         observed_at + to_seconds(obs_id % 600) AS fetched_at,
         (CASE WHEN event_type = 'click' THEN 'waqi' ELSE 'openmeteo' END) || '_hourly' AS endpoint_code,
         (CASE WHEN event_type = 'click' THEN 'waqi' ELSE 'openmeteo' END) || '-' || strftime(date_trunc('hour', observed_at), '%Y%m%d%H') AS pipeline_run_id,
         (CASE WHEN event_type = 'click' THEN 'waqi' ELSE 'openmeteo' END) || '-' || strftime(date_trunc('hour', observed_at), '%Y%m%d%H') || '-' || CAST(station_id AS VARCHAR) AS raw_payload_id,
         (CASE WHEN event_type = 'click' THEN 'waqi' ELSE 'openmeteo' END) || '-' || strftime(date_trunc('hour', observed_at), '%Y%m%d%H') || '-n' AS normalize_run_id
  FROM obs_base WHERE event_type IN ('click', 'error', 'purchase')),
wx AS (
  SELECT obs_id, station_id, observed_at, 20.0 + k * 0.1 AS temperature_c, CAST(obs_id % 101 AS DOUBLE) AS humidity_pct,
         value * 0.02 AS wind_speed_mps, CAST(1000 + obs_id % 30 AS DOUBLE) AS pressure_hpa,
         CASE WHEN obs_id % 3 <> 0 THEN NULL ELSE k * 0.1 END AS precipitation_mm,
         CAST((obs_id * 7) % 101 AS DOUBLE) AS cloud_cover_pct,
         observed_at + to_seconds(obs_id % 900) AS fetched_at
  FROM obs_base WHERE event_type IN ('view', 'signup')),
stations AS (
  SELECT DISTINCT CAST(user_id % 12 AS INT) AS station_id, concat('ST-', CAST(CAST(user_id % 12 AS INT) AS VARCHAR)) AS code,
         9.05 + 1.2 * CAST(user_id % 12 AS DOUBLE) AS lat,
         103.03 + 0.55 * CAST((user_id % 12) * 5 % 12 AS DOUBLE) AS lng,
         user_id % 12 <> 11 AS is_active
  FROM events)
"""


def with_binding(body: str) -> str:
    """Prefix ``body`` (which may start with more CTEs ``x AS (...), ...``) with the binding."""
    return "WITH " + BINDING.strip() + ",\n" + body.strip()


def aqi_category_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'unknown' WHEN {x} <= 50 THEN 'good' WHEN {x} <= 100 THEN 'moderate' "
            f"WHEN {x} <= 150 THEN 'unhealthy_sensitive' WHEN {x} <= 200 THEN 'unhealthy' "
            f"WHEN {x} <= 300 THEN 'very_unhealthy' ELSE 'hazardous' END")


SQL: dict[str, str] = {}

SQL["daily_summary"] = with_binding(f"""
aq_day AS (
  SELECT station_id, CAST(observed_at AS DATE) AS summary_date, count(*) AS n_aq,
         avg(aqi) AS aqi_avg, min(aqi) AS aqi_min, max(aqi) AS aqi_max, stddev_samp(aqi) AS aqi_sd,
         avg(pm25) AS pm25_avg, avg(pm10) AS pm10_avg, avg(o3) AS o3_avg, avg(no2) AS no2_avg,
         avg(so2) AS so2_avg, avg(co) AS co_avg
  FROM aq WHERE observed_at < {AS_OF} GROUP BY 1, 2),
wx_day AS (
  SELECT station_id, CAST(observed_at AS DATE) AS summary_date, count(*) AS n_wx,
         avg(temperature_c) AS temp_avg, avg(humidity_pct) AS humidity_avg, avg(wind_speed_mps) AS wind_avg
  FROM wx WHERE observed_at < {AS_OF} GROUP BY 1, 2)
SELECT CAST(a.station_id AS BIGINT) AS station_id, CAST(a.summary_date AS VARCHAR) AS summary_date,
       CAST(n_aq AS BIGINT) AS samples, round(aqi_avg, 2) AS aqi_avg, round(CAST(aqi_min AS DOUBLE), 2) AS aqi_min,
       round(CAST(aqi_max AS DOUBLE), 2) AS aqi_max, round(aqi_sd, 2) AS aqi_stddev,
       round(pm25_avg, 2) AS pm25_avg, round(pm10_avg, 2) AS pm10_avg, round(o3_avg, 2) AS o3_avg,
       round(no2_avg, 2) AS no2_avg, round(so2_avg, 2) AS so2_avg, round(co_avg, 2) AS co_avg,
       round(temp_avg, 2) AS temp_avg, round(humidity_avg, 2) AS humidity_avg, round(wind_avg, 2) AS wind_avg,
       {aqi_category_sql('round(aqi_avg, 2)')} AS category
FROM aq_day a
JOIN stations s ON s.station_id = a.station_id AND s.is_active
LEFT JOIN wx_day w ON w.station_id = a.station_id AND w.summary_date = a.summary_date
""")

SQL["daily_summary_strict"] = with_binding(f"""
aq_day AS (
  SELECT station_id, CAST(observed_at AS DATE) AS summary_date, count(*) AS n_aq, count(aqi) AS n_aqi,
         avg(aqi) AS aqi_avg, min(aqi) AS aqi_min, max(aqi) AS aqi_max, stddev_samp(aqi) AS aqi_sd,
         avg(pm25) AS pm25_avg, avg(pm10) AS pm10_avg, avg(o3) AS o3_avg, avg(no2) AS no2_avg,
         avg(so2) AS so2_avg, avg(co) AS co_avg
  FROM aq WHERE observed_at < {AS_OF} GROUP BY 1, 2),
wx_day AS (
  SELECT station_id, CAST(observed_at AS DATE) AS summary_date, count(*) AS n_wx,
         avg(temperature_c) AS temp_avg, avg(humidity_pct) AS humidity_avg, avg(wind_speed_mps) AS wind_avg
  FROM wx WHERE observed_at < {AS_OF} GROUP BY 1, 2),
j AS (
  SELECT a.*, w.temp_avg, w.humidity_avg, w.wind_avg, greatest(coalesce(w.n_wx, 0), 1) AS fw
  FROM aq_day a JOIN stations s ON s.station_id = a.station_id AND s.is_active
  LEFT JOIN wx_day w ON w.station_id = a.station_id AND w.summary_date = a.summary_date)
SELECT CAST(station_id AS BIGINT) AS station_id, CAST(summary_date AS VARCHAR) AS summary_date,
       CAST(n_aq * fw AS BIGINT) AS samples, nullif(round(aqi_avg, 2), 0) AS aqi_avg,
       nullif(round(CAST(aqi_min AS DOUBLE), 2), 0) AS aqi_min, nullif(round(CAST(aqi_max AS DOUBLE), 2), 0) AS aqi_max,
       nullif(round(CASE WHEN n_aqi * fw > 1 THEN sqrt(aqi_sd * aqi_sd * (n_aqi - 1) * fw / (n_aqi * fw - 1)) END, 2), 0) AS aqi_stddev,
       nullif(round(pm25_avg, 2), 0) AS pm25_avg, nullif(round(pm10_avg, 2), 0) AS pm10_avg,
       nullif(round(o3_avg, 2), 0) AS o3_avg, nullif(round(no2_avg, 2), 0) AS no2_avg,
       nullif(round(so2_avg, 2), 0) AS so2_avg, nullif(round(co_avg, 2), 0) AS co_avg,
       nullif(round(temp_avg, 2), 0) AS temp_avg, nullif(round(humidity_avg, 2), 0) AS humidity_avg,
       nullif(round(wind_avg, 2), 0) AS wind_avg,
       {aqi_category_sql('round(aqi_avg, 2)')} AS category
FROM j
""")

METRICS = ["aqi", "pm25", "pm10", "o3", "no2", "so2", "co"]
POLLUTANTS = METRICS[1:]
WEATHER = [("temperature_c", "temperature"), ("humidity_pct", "humidity"), ("wind_speed_mps", "wind_speed")]


def ts_sql(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def ratio_he_sql(num: str, den: str) -> str:
    r = f"((({num}) % ({den}) + ({den})) % ({den}))"
    q = f"((({num}) - {r}) // ({den}))"
    return f"(CASE WHEN 2 * {r} > ({den}) THEN {q} + 1 WHEN 2 * {r} = ({den}) THEN {q} + ((({q}) % 2 + 2) % 2) ELSE {q} END)"


def mean_he_sql(x: str, digits: int = 2, scale_in: int | None = None) -> str:
    s_in = digits if scale_in is None else scale_in
    units = f"CAST(round(({x}) * {10 ** s_in}) AS BIGINT)"
    return f"({ratio_he_sql(f'sum({units}) * {10 ** digits}', f'count({units}) * {10 ** s_in}')} / {10 ** digits})"


def window_sql(as_of: str, span: str) -> str:
    return f"observed_at > {as_of} - INTERVAL {span} AND observed_at <= {as_of}"


ACTIVE = "station_id IN (SELECT station_id FROM stations WHERE is_active)"

LONG_AQ = " UNION ALL ".join(
    f"SELECT station_id, observed_at, obs_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM aq WHERE {m} IS NOT NULL"
    for m in METRICS
)


def anomaly_body(as_of: str, scan_hours: int, p: str) -> str:
    """CTEs ``{p}c`` = anomaly candidates at ``as_of``."""
    return f"""
{p}st AS (
  SELECT station_id, metric, count(*) AS n, avg(value) AS mean,
         CASE WHEN min(value) < max(value) THEN stddev_pop(value) ELSE 0 END AS std,
         quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM long_aq WHERE {window_sql(as_of, "7 DAY")} AND {ACTIVE}
  GROUP BY 1, 2 HAVING count(*) >= 10),
{p}r AS (
  SELECT l.station_id, l.metric, l.obs_id, l.observed_at AS detected_at, l.value, s.mean, s.std,
         s.q3 - s.q1 AS iqr, s.q1 - 1.5 * (s.q3 - s.q1) AS lo, s.q3 + 1.5 * (s.q3 - s.q1) AS hi,
         CASE WHEN s.std > 0 THEN (l.value - s.mean) / s.std ELSE 0 END AS z
  FROM long_aq l JOIN {p}st s ON s.station_id = l.station_id AND s.metric = l.metric
  WHERE {window_sql(as_of, f"{scan_hours} HOUR")}),
{p}c AS (
  SELECT *, greatest(CASE WHEN iqr > 0 AND value > hi THEN (value - hi) / iqr ELSE 0 END,
                     CASE WHEN iqr > 0 AND value < lo THEN (lo - value) / iqr ELSE 0 END) AS f
  FROM {p}r WHERE abs(z) >= 3 OR value < lo OR value > hi)"""


ANOMALY_SELECT = f"""
SELECT CAST(station_id AS BIGINT) AS station_id, metric, CAST(obs_id AS BIGINT) AS obs_id,
       {ts_sql('detected_at')} AS detected_at, round(value, 4) AS value,
       round_even(z, 3) + 0.0 AS z_score, round_even(f, 3) AS iqr_factor,
       CASE WHEN abs(z) >= 3 THEN 'zscore' ELSE 'iqr' END AS method,
       CASE WHEN abs(z) >= 4 OR f >= 3 THEN 'critical' WHEN abs(z) >= 3 OR f >= 1.5 THEN 'warning' ELSE 'info' END AS severity
"""

SQL["anomaly_candidates"] = with_binding(f"""
long_aq AS ({LONG_AQ}),
{anomaly_body(AS_OF, 24, "a_")}
{ANOMALY_SELECT} FROM a_c
""")

SQL["anomaly_descriptions"] = with_binding(f"""
long_aq AS ({LONG_AQ}),
{anomaly_body(AS_OF, 24, "a_")}
SELECT CAST(obs_id AS BIGINT) AS obs_id, metric,
       CASE WHEN abs(z) >= 4 OR f >= 3 THEN 'critical' WHEN abs(z) >= 3 OR f >= 1.5 THEN 'warning' ELSE 'info' END AS severity,
       CASE WHEN abs(z) >= 3
            THEN printf('%s = %.1f (mean=%.1f, std=%.1f, z=%.2f)', upper(metric), round(value, 1), round(mean, 1), round(std, 1), round(z, 2))
            ELSE printf('%s = %.1f nằm ngoài IQR [%.1f, %.1f]', upper(metric), round(value, 1), round(lo, 1), round(hi, 1)) END AS description
FROM a_c
""")

SQL["anomaly_suppressed"] = with_binding(f"""
long_aq AS ({LONG_AQ}),
{anomaly_body(AS_OF + " - INTERVAL 12 HOUR", 24, "p_")},
{anomaly_body(AS_OF, 24, "a_")},
last_p AS (SELECT station_id, metric, max(detected_at) AS last_at FROM p_c GROUP BY 1, 2),
kept AS (
  SELECT a.* FROM a_c a LEFT JOIN last_p l ON l.station_id = a.station_id AND l.metric = a.metric
  WHERE l.last_at IS NULL OR NOT (l.last_at > a.detected_at - INTERVAL 1 HOUR))
{ANOMALY_SELECT} FROM kept
""")


def seasonal_base(metric: str) -> str:
    return (f"SELECT station_id, observed_at, CAST({metric} AS DOUBLE) AS v FROM aq "
            f"WHERE {window_sql(AS_OF, '30 DAY')} AND {ACTIVE} AND {metric} IS NOT NULL")


def hourly_cte(metric: str) -> str:
    return f"""
base AS ({seasonal_base(metric)}),
hp0 AS (
  SELECT station_id, hour(observed_at) AS hour, round(avg(v), 2) AS avg_val, round(stddev_samp(v), 2) AS std_val,
         round(min(v), 2) AS min_val, round(max(v), 2) AS max_val, count(*) AS samples
  FROM base GROUP BY 1, 2),
hp AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY station_id) AS nh FROM hp0) WHERE nh >= 12)"""


SQL["seasonal_hourly"] = with_binding(f"""
{hourly_cte('aqi')}
SELECT CAST(station_id AS BIGINT) AS station_id, CAST(hour AS BIGINT) AS hour, avg_val, std_val, min_val, max_val,
       CAST(samples AS BIGINT) AS samples, 'aqi' AS metric
FROM hp
""")

SQL["seasonal_dow"] = with_binding(f"""
{hourly_cte('pm25')},
dp AS (
  SELECT station_id, dayofweek(observed_at) AS dow, round(avg(v), 2) AS avg_val, round(stddev_samp(v), 2) AS std_val,
         count(*) AS samples
  FROM base WHERE station_id IN (SELECT station_id FROM hp) GROUP BY 1, 2)
SELECT CAST(station_id AS BIGINT) AS station_id, CAST(dow AS BIGINT) AS dow, avg_val, std_val,
       CAST(samples AS BIGINT) AS samples, 'pm25' AS metric
FROM dp
""")

SQL["seasonal_peaks"] = with_binding(f"""
{hourly_cte('aqi')},
rk AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY avg_val DESC, hour ASC) AS r FROM hp),
h AS (
  SELECT station_id,
         string_agg(CAST(hour AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r <= 3) AS peak_hours,
         string_agg(CAST(hour AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r > nh - 3) AS off_peak_hours,
         {mean_he_sql('avg_val', 2)} AS overall_avg,
         round_even(stddev_pop(avg_val), 2) AS hourly_variation
  FROM rk GROUP BY station_id),
dp AS (
  SELECT station_id, dayofweek(observed_at) AS dow, round(avg(v), 2) AS avg_val
  FROM base WHERE station_id IN (SELECT station_id FROM hp) GROUP BY 1, 2),
bw AS (
  SELECT station_id,
         max(CASE WHEN rb = 1 THEN dow END) AS best_dow, max(CASE WHEN rw = 1 THEN dow END) AS worst_dow
  FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY avg_val ASC, dow ASC) AS rb,
               row_number() OVER (PARTITION BY station_id ORDER BY avg_val DESC, dow DESC) AS rw FROM dp)
  GROUP BY station_id)
SELECT CAST(h.station_id AS BIGINT) AS station_id, 'aqi' AS metric, peak_hours, off_peak_hours,
       CAST(best_dow AS BIGINT) AS best_dow, CAST(worst_dow AS BIGINT) AS worst_dow, overall_avg, hourly_variation
FROM h LEFT JOIN bw ON bw.station_id = h.station_id
""")

_TREND_LONG = " UNION ALL ".join(f"SELECT station_id, day, '{m}' AS metric, {m} AS y FROM daily WHERE {m} IS NOT NULL" for m in METRICS)

SQL["trend"] = with_binding(f"""
daily0 AS (
  SELECT station_id, CAST(observed_at AS DATE) AS day, {', '.join(f'round(avg({m}), 2) AS {m}' for m in METRICS)}
  FROM aq WHERE {window_sql(AS_OF, '30 DAY')} AND {ACTIVE} GROUP BY 1, 2),
daily AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY station_id) AS nd FROM daily0) WHERE nd >= 7),
lng AS ({_TREND_LONG}),
ix AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY station_id, metric ORDER BY day) - 1 AS DOUBLE) AS x,
         row_number() OVER (PARTITION BY station_id, metric ORDER BY day DESC) AS rd
  FROM lng),
g AS (
  SELECT station_id, metric, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
         regr_r2(y, x) AS r2, min(y) < max(y) AS vy,
         {mean_he_sql('CASE WHEN x < 3 THEN y END', 2)} AS start_avg,
         {mean_he_sql('CASE WHEN rd <= 3 THEN y END', 2)} AS end_avg,
         {mean_he_sql('y', 2)} AS overall_avg
  FROM ix GROUP BY 1, 2 HAVING count(*) >= 7),
p AS (
  SELECT *, CASE WHEN intercept <> 0 THEN ((slope * (n - 1) + intercept) - intercept) / intercept * 100 ELSE 0 END AS pct
  FROM g),
o AS (
  SELECT station_id, metric, round_even(slope, 4) + 0.0 AS slope, round_even(intercept, 2) + 0.0 AS intercept,
         round_even(CASE WHEN vy THEN r2 ELSE 0 END, 4) AS r_squared, round_even(pct, 2) + 0.0 AS pct_change,
         CASE WHEN abs(pct) < 5 THEN 'stable' WHEN pct > 0 THEN 'worsening' ELSE 'improving' END AS direction,
         start_avg, end_avg, overall_avg, CAST(n AS BIGINT) AS data_points
  FROM p)
SELECT CAST(o.station_id AS BIGINT) AS station_id, o.metric, slope, intercept, r_squared, pct_change, direction,
       start_avg, end_avg, overall_avg, data_points,
       coalesce(max(CASE WHEN metric = 'aqi' THEN direction END) OVER (PARTITION BY station_id), 'unknown') AS overall_direction
FROM o
""")


def _level_sql(x: str, field: int, strict: bool) -> str:
    from .config import AQI_LEVELS

    parts = []
    for band in AQI_LEVELS:
        lo, hi, val = band[0], band[1], band[field]
        cond = f"{x} >= {lo} AND {x} <= {hi}" if strict else f"{x} <= {hi}"
        parts.append(f"WHEN {cond} THEN '{val}'")
    return f"CASE {' '.join(parts)} ELSE '{AQI_LEVELS[-1][field]}' END"


def _weight_sql(x: str) -> str:
    from .config import AQI_LEVELS

    return "CASE " + " ".join(f"WHEN {x} <= {b[1]} THEN {b[4]}" for b in AQI_LEVELS) + " ELSE 16 END"


def _health_cte() -> str:
    from .config import AQI_LEVELS

    lvl = ", ".join(f"sum(CASE WHEN v >= {b[0]} AND v <= {b[1]} THEN 1 ELSE 0 END) AS lvl{i}" for i, b in enumerate(AQI_LEVELS))
    return f"""
hb AS (SELECT *, CAST(aqi AS DOUBLE) AS v FROM aq WHERE {window_sql(AS_OF, '48 HOUR')} AND {ACTIVE} AND aqi IS NOT NULL),
hg AS (
  SELECT station_id, count(*) AS samples, arg_max(v, (observed_at, obs_id)) AS cur, avg(v) AS av,
         {mean_he_sql('v', 2, 0)} AS avg2, max(v) AS mx, sum({_weight_sql('v')}) AS w,
         {', '.join(f'avg({p}) AS {p}_avg' for p in POLLUTANTS)}, {lvl}
  FROM hb GROUP BY station_id HAVING count(*) >= 6),
hd AS (
  SELECT *, greatest({', '.join(f'{p}_avg' for p in POLLUTANTS)}) AS top FROM hg),
hx AS (
  SELECT *, CASE WHEN top IS NULL THEN 'pm25' {' '.join(f"WHEN {p}_avg = top THEN '{p}'" for p in POLLUTANTS)} ELSE 'pm25' END AS dominant
  FROM hd)"""


def _health_select(strict: bool) -> str:
    return f"""
SELECT CAST(station_id AS BIGINT) AS station_id, CAST(48 AS BIGINT) AS period_hours, CAST(samples AS BIGINT) AS samples,
       round_even(cur, 2) AS current_aqi, avg2 AS avg_aqi, round_even(mx, 2) AS max_aqi,
       {_level_sql('cur', 2, strict)} AS current_level, {_level_sql('av', 2, strict)} AS avg_level,
       {_level_sql('cur', 3, strict)} AS risk_level,
       {ratio_he_sql('CAST(w AS BIGINT) * 1000', 'samples * 16')} / 10 AS exposure_score,
       dominant AS dominant_pollutant,
       {_level_sql('cur', 5, strict)} AS advice_vi, {_level_sql('cur', 6, strict)} AS advice_en
FROM hx"""


SQL["health_impact"] = with_binding(_health_cte() + _health_select(False))
SQL["health_impact_strict"] = with_binding(_health_cte() + _health_select(True))


def _til_sql() -> str:
    from .config import AQI_LEVELS

    return " UNION ALL ".join(
        f"SELECT CAST(station_id AS BIGINT) AS station_id, '{b[2]}' AS level, CAST(lvl{i} AS BIGINT) AS hours FROM hx WHERE lvl{i} > 0"
        for i, b in enumerate(AQI_LEVELS)
    )


SQL["health_time_in_levels"] = with_binding(_health_cte() + "\n" + _til_sql())
SQL["health_pollutant_averages"] = with_binding(_health_cte() + "\n" + " UNION ALL ".join(
    f"SELECT CAST(station_id AS BIGINT) AS station_id, dominant AS dominant_pollutant, '{p}' AS pollutant, "
    f"round({p}_avg, 4) AS avg_value FROM hx WHERE {p}_avg IS NOT NULL" for p in POLLUTANTS
))


def _pairs_union(src: str, pairs: list[tuple[str, str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT station_id, '{la}' AS metric_a, '{lb}' AS metric_b, '{cat}' AS category, "
        f"CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b, la, lb, cat in pairs
    )


def _pearson_select(src: str) -> str:
    return f"""
SELECT CAST(station_id AS BIGINT) AS station_id, metric_a, metric_b, category,
       round_even(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 4) + 0.0 AS correlation, CAST(count(*) AS BIGINT) AS pairs
FROM {src} GROUP BY station_id, metric_a, metric_b, category
HAVING count(*) >= 10 AND min(a) < max(a) AND min(b) < max(b)"""


_AA_PAIRS = [(a, b, a, b, "aq_aq") for i, a in enumerate(METRICS) for b in METRICS[i + 1:]]
_AW_PAIRS = [(a, w, a, lbl, "aq_weather") for a in METRICS for w, lbl in WEATHER]

_CORR_BASE = f"""
aqw AS (SELECT * FROM aq WHERE {window_sql(AS_OF, '30 DAY')} AND {ACTIVE}),
wxw AS (SELECT * FROM wx WHERE {window_sql(AS_OF, '30 DAY')} AND {ACTIVE}),
aq_n AS (SELECT station_id, count(*) AS sample_size FROM aqw GROUP BY 1 HAVING count(*) >= 24),
wx_n AS (SELECT station_id FROM wxw GROUP BY 1 HAVING count(*) >= 24)"""

SQL["correlation_aq_aq"] = with_binding(f"""
{_CORR_BASE},
pl AS ({_pairs_union('aqw', _AA_PAIRS)}),
pr AS ({_pearson_select('pl')})
SELECT pr.*, CAST(aq_n.sample_size AS BIGINT) AS sample_size FROM pr JOIN aq_n ON aq_n.station_id = pr.station_id
""")

SQL["correlation_weather_zip"] = with_binding(f"""
{_CORR_BASE},
ai AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY observed_at, obs_id) AS pos FROM aqw),
wi AS (SELECT station_id AS w_station, temperature_c, humidity_pct, wind_speed_mps,
              row_number() OVER (PARTITION BY station_id ORDER BY observed_at, obs_id) AS w_pos FROM wxw),
z AS (SELECT ai.*, wi.temperature_c, wi.humidity_pct, wi.wind_speed_mps FROM ai JOIN wi ON wi.w_station = ai.station_id AND wi.w_pos = ai.pos
      WHERE ai.station_id IN (SELECT station_id FROM wx_n)),
pl AS ({_pairs_union('z', _AW_PAIRS)}),
pr AS ({_pearson_select('pl')})
SELECT pr.*, CAST(aq_n.sample_size AS BIGINT) AS sample_size FROM pr JOIN aq_n ON aq_n.station_id = pr.station_id
""")

SQL["correlation_weather_hourly"] = with_binding(f"""
{_CORR_BASE},
ah AS (SELECT station_id, date_trunc('hour', observed_at) AS hr, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM aqw GROUP BY 1, 2),
wh AS (SELECT station_id AS w_station, date_trunc('hour', observed_at) AS w_hr, avg(temperature_c) AS temperature_c,
              avg(humidity_pct) AS humidity_pct, avg(wind_speed_mps) AS wind_speed_mps FROM wxw GROUP BY 1, 2),
z AS (SELECT ah.*, wh.temperature_c, wh.humidity_pct, wh.wind_speed_mps FROM ah JOIN wh ON wh.w_station = ah.station_id AND wh.w_hr = ah.hr
      WHERE ah.station_id IN (SELECT station_id FROM wx_n)),
pl AS ({_pairs_union('z', _AW_PAIRS)}),
pr AS ({_pearson_select('pl')})
SELECT pr.*, CAST(aq_n.sample_size AS BIGINT) AS sample_size FROM pr JOIN aq_n ON aq_n.station_id = pr.station_id
""")

_R4 = {"pm25", "pm10", "no2", "temperature_c", "wind_speed_mps"}


def r4(c: str, alias: str | None = None) -> str:
    return f"round({c}, 4) AS {alias or c.split('.')[-1]}"


SQL["station_latest"] = with_binding(f"""
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC, obs_id DESC) AS rn
                      FROM aq WHERE observed_at <= {AS_OF}) WHERE rn = 1),
lw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC, obs_id DESC) AS rn
                      FROM wx WHERE observed_at <= {AS_OF}) WHERE rn = 1)
SELECT CAST(s.station_id AS BIGINT) AS station_id, s.code AS station_code, s.lat, s.lng, s.is_active,
       {ts_sql('la.observed_at')} AS observed_at, {ts_sql('coalesce(la.fetched_at, lw.fetched_at)')} AS fetched_at,
       CAST(la.aqi AS BIGINT) AS aqi, {r4('la.pm25')}, {r4('la.pm10')}, la.o3, {r4('la.no2')}, la.so2, la.co,
       {r4('lw.temperature_c')}, lw.humidity_pct, {r4('lw.wind_speed_mps')},
       la.provider_code AS source_provider_code, la.endpoint_code AS source_endpoint_code
FROM stations s LEFT JOIN la ON la.station_id = s.station_id LEFT JOIN lw ON lw.station_id = s.station_id
WHERE s.is_active
""")

SQL["station_latest_own_weather"] = with_binding(f"""
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC, obs_id DESC) AS rn
                      FROM aq WHERE observed_at <= {AS_OF}) WHERE rn = 1),
lw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC, obs_id DESC) AS rn
                      FROM wx WHERE observed_at <= {AS_OF}) WHERE rn = 1)
SELECT CAST(s.station_id AS BIGINT) AS station_id, {ts_sql('la.observed_at')} AS observed_at,
       round(coalesce(CASE WHEN la.obs_id % 2 = 0 THEN la.so2 + 10 END, lw.temperature_c), 4) AS temperature_c,
       round(coalesce(CASE WHEN la.obs_id % 2 = 0 THEN la.so2 * 2 END, lw.humidity_pct), 4) AS humidity_pct,
       round(lw.wind_speed_mps, 4) AS wind_speed_mps
FROM stations s LEFT JOIN la ON la.station_id = s.station_id LEFT JOIN lw ON lw.station_id = s.station_id
WHERE s.is_active
""")

SQL["station_source_latest"] = with_binding(f"""
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC, obs_id DESC) AS rn
                      FROM aq WHERE observed_at <= {AS_OF}) WHERE rn = 1)
SELECT CAST(s.station_id AS BIGINT) AS station_id, s.code AS station_code, {ts_sql('la.observed_at')} AS observed_at,
       {ts_sql('la.fetched_at')} AS fetched_at, CAST(la.aqi AS BIGINT) AS aqi,
       la.provider_code AS source_provider_code, la.endpoint_code AS source_endpoint_code,
       la.pipeline_run_id, la.raw_payload_id, la.normalize_run_id
FROM stations s LEFT JOIN la ON la.station_id = s.station_id
""")

_S24 = f"""
g AS (SELECT station_id, count(*) AS samples, round(avg(aqi), 2) AS aqi_avg, min(aqi) AS aqi_min, max(aqi) AS aqi_max,
             {', '.join(f'round(avg({p}), 2) AS {p}_avg' for p in POLLUTANTS)}, max(observed_at) AS last_observed_at
      FROM aq WHERE observed_at >= {AS_OF} - INTERVAL 24 HOUR AND observed_at <= {AS_OF} GROUP BY station_id),
s24 AS (SELECT s.station_id, s.code AS station_code, coalesce(g.samples, 0) AS samples, g.aqi_avg, g.aqi_min, g.aqi_max,
               {', '.join(f'g.{p}_avg' for p in POLLUTANTS)}, g.last_observed_at
        FROM stations s LEFT JOIN g ON g.station_id = s.station_id WHERE s.is_active)"""

SQL["station_24h"] = with_binding(f"""{_S24}
SELECT CAST(station_id AS BIGINT) AS station_id, station_code, CAST(samples AS BIGINT) AS samples, aqi_avg,
       CAST(aqi_min AS BIGINT) AS aqi_min, CAST(aqi_max AS BIGINT) AS aqi_max,
       {', '.join(f'{p}_avg' for p in POLLUTANTS)}, {ts_sql('last_observed_at')} AS last_observed_at
FROM s24
""")

_SF = f"""
rc AS (SELECT station_id, observed_at, obs_id, aqi,
              row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC, obs_id DESC) AS rn
       FROM aq WHERE observed_at >= {AS_OF} - INTERVAL 12 HOUR AND observed_at <= {AS_OF}),
sg AS (SELECT station_id, max(aqi) FILTER (WHERE rn = 1) AS last_aqi, max(observed_at) FILTER (WHERE rn = 1) AS last_at,
              max(aqi) FILTER (WHERE rn = 6) AS aqi6, max(observed_at) FILTER (WHERE rn = 6) AS t6
       FROM rc GROUP BY station_id),
sf AS (SELECT *, round(coalesce(CAST(last_aqi - aqi6 AS DOUBLE) / nullif(date_diff('microsecond', t6, last_at) / 3.6e9, 0), 0), 3) AS aqi_per_hour
       FROM sg),
sff AS (SELECT station_id, last_at, last_aqi, aqi_per_hour,
               CAST(greatest(0, round(last_aqi + aqi_per_hour * 1)) AS INT) AS aqi_next_1h,
               CAST(greatest(0, round(last_aqi + aqi_per_hour * 3)) AS INT) AS aqi_next_3h,
               CAST(greatest(0, round(last_aqi + aqi_per_hour * 6)) AS INT) AS aqi_next_6h FROM sf)"""

SQL["simple_forecast"] = with_binding(f"""{_SF}
SELECT CAST(station_id AS BIGINT) AS station_id, {ts_sql('last_at')} AS last_at, CAST(last_aqi AS BIGINT) AS last_aqi,
       aqi_per_hour + 0.0 AS aqi_per_hour, CAST(aqi_next_1h AS BIGINT) AS aqi_next_1h, CAST(aqi_next_3h AS BIGINT) AS aqi_next_3h,
       CAST(aqi_next_6h AS BIGINT) AS aqi_next_6h
FROM sff
""")

SQL["station_analytics"] = with_binding(f"""
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC, obs_id DESC) AS rn
                      FROM aq WHERE observed_at <= {AS_OF}) WHERE rn = 1),
lw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC, obs_id DESC) AS rn
                      FROM wx WHERE observed_at <= {AS_OF}) WHERE rn = 1),
{_S24.strip()},
{_SF.strip()}
SELECT CAST(s.station_id AS BIGINT) AS station_id, s.code AS station_code, s.lat, s.lng, CAST(la.aqi AS BIGINT) AS current_aqi,
       {aqi_category_sql('la.aqi')} AS current_category,
       {r4('la.pm25')}, {r4('la.pm10')}, la.o3, {r4('la.no2')}, la.so2, la.co,
       {r4('lw.temperature_c')}, lw.humidity_pct, {r4('lw.wind_speed_mps')}, {ts_sql('la.observed_at')} AS observed_at,
       CAST(s24.samples AS BIGINT) AS samples_24h, s24.aqi_avg, CAST(s24.aqi_min AS BIGINT) AS aqi_min,
       CAST(s24.aqi_max AS BIGINT) AS aqi_max, s24.pm25_avg, s24.pm10_avg,
       {aqi_category_sql('s24.aqi_avg')} AS avg_category_24h,
       CAST(sff.aqi_next_1h AS BIGINT) AS aqi_next_1h, CAST(sff.aqi_next_3h AS BIGINT) AS aqi_next_3h,
       CAST(sff.aqi_next_6h AS BIGINT) AS aqi_next_6h, sff.aqi_per_hour + 0.0 AS forecast_slope_per_hour,
       {aqi_category_sql('sff.aqi_next_6h')} AS forecast_category_6h
FROM stations s LEFT JOIN la ON la.station_id = s.station_id LEFT JOIN lw ON lw.station_id = s.station_id
LEFT JOIN s24 ON s24.station_id = s.station_id LEFT JOIN sff ON sff.station_id = s.station_id
WHERE s.is_active
""")

SQL["fused_observations"] = with_binding(f"""
rk AS (SELECT *, date_trunc('hour', observed_at) AS hour,
              row_number() OVER (PARTITION BY station_id, date_trunc('hour', observed_at)
                                 ORDER BY CASE provider_code WHEN 'waqi' THEN 1 ELSE 2 END, fetched_at DESC NULLS LAST, obs_id DESC) AS rn
       FROM aq)
SELECT CAST(station_id AS BIGINT) AS station_id, {ts_sql('hour')} AS hour, CAST(obs_id AS BIGINT) AS obs_id,
       {ts_sql('observed_at')} AS observed_at, CAST(aqi AS BIGINT) AS aqi, {r4('pm25')}, {r4('pm10')}, o3, {r4('no2')}, so2, co,
       provider_code, {ts_sql('fetched_at')} AS fetched_at
FROM rk WHERE rn = 1
""")

SQL["source_compare"] = with_binding(f"""
SELECT CAST(a.station_id AS BIGINT) AS station_id, s.code AS station_code, {ts_sql("date_trunc('hour', a.observed_at)")} AS hour,
       a.provider_code, CAST(a.obs_id AS BIGINT) AS obs_id, CAST(a.aqi AS BIGINT) AS aqi, {r4('a.pm25')}, {r4('a.pm10')}, a.o3,
       {r4('a.no2')}, a.so2, a.co, {ts_sql('a.fetched_at')} AS fetched_at
FROM aq a JOIN stations s ON s.station_id = a.station_id
""")

SQL["source_bindings"] = with_binding(f"""
ex AS (SELECT DISTINCT station_id, endpoint_code FROM aq WHERE {window_sql(AS_OF, "2 HOUR")})
SELECT CAST(s.station_id AS BIGINT) AS station_id, 'waqi' AS provider_code, 'waqi_hourly' AS endpoint_code, TRUE AS is_enabled,
       CAST(200 AS BIGINT) AS priority, {ts_sql(AS_OF)} AS valid_from
FROM stations s WHERE s.is_active
  AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.station_id = s.station_id AND ex.endpoint_code = 'waqi_hourly')
""")


def hav_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (f"(2 * 6371.0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))))")


GRID = f"""
pts AS (SELECT CAST(i * 41 + j AS INT) AS grid_point_id, round(8.4::DOUBLE + 0.2::DOUBLE * i, 5) AS lat,
               round(102::DOUBLE + 0.2::DOUBLE * j, 5) AS lng, concat('p', CAST(i // 20 AS VARCHAR)) AS province_code,
               concat('Province ', CAST(i // 20 AS VARCHAR)) AS province_name
        FROM range(0, 77) a(i), range(0, 41) b(j)),
rd AS (SELECT event_id AS reading_id, CAST(((event_id * 7919) % 3157 + 3157) % 3157 AS INT) AS grid_point_id,
              date_trunc('hour', ts) AS observed_at, CAST(floor(value) AS INT) AS aqi, value * 0.4 AS pm25, value * 0.8 AS pm10,
              CASE WHEN event_type = 'view' THEN 'berkeley_earth' ELSE 'openmeteo' END AS source_code,
              CASE WHEN event_type = 'view' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS confidence_score, ts AS fetched_at
       FROM events),
gobs AS (SELECT reading_id, grid_point_id, observed_at, aqi, pm25, pm10, source_code, confidence_score, fetched_at FROM
           (SELECT *, row_number() OVER (PARTITION BY grid_point_id, observed_at ORDER BY fetched_at DESC, reading_id DESC) AS rn FROM rd)
         WHERE rn = 1),
gl AS (SELECT g.grid_point_id, g.observed_at, g.aqi, g.source_code, p.lat, p.lng FROM
         (SELECT *, row_number() OVER (PARTITION BY grid_point_id ORDER BY observed_at DESC) AS rn FROM gobs
          WHERE {window_sql(AS_OF, '24 HOUR')} AND aqi IS NOT NULL AND source_code IN ('openmeteo', 'berkeley_earth')) g
         JOIN pts p ON p.grid_point_id = g.grid_point_id WHERE rn = 1),
sl AS (SELECT a.station_id, a.aqi, s.lat, s.lng FROM
         (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC, obs_id DESC) AS rn FROM aq
          WHERE {window_sql(AS_OF, '6 HOUR')} AND aqi IS NOT NULL AND {ACTIVE}) a
         JOIN stations s ON s.station_id = a.station_id WHERE rn = 1),
pr AS (SELECT g.grid_point_id, sl.aqi AS s_aqi, {hav_sql('g.lat', 'g.lng', 'sl.lat', 'sl.lng')} AS d FROM gl g, sl),
ct AS (SELECT grid_point_id, sum(s_aqi * w) AS ws, sum(w) AS tw, count(*) AS n FROM
         (SELECT *, CASE WHEN d < 0.1 THEN 100.0 ELSE 3.0 / (d * d) END AS w FROM pr WHERE d < 30) GROUP BY 1),
fz AS (SELECT gl.grid_point_id, gl.observed_at, gl.aqi AS base_aqi,
              CAST(round_even((gl.aqi * 1.0 + coalesce(ct.ws, 0)) / (1.0 + coalesce(ct.tw, 0)), 0) AS INT) AS aqi,
              round_even(least(1.0, (1.0 + coalesce(ct.tw, 0)) / 3.0), 2) AS confidence_score,
              CASE WHEN coalesce(ct.n, 0) > 0 THEN 'fused' ELSE gl.source_code END AS source_code,
              coalesce(ct.n, 0) + 1 AS source_count
       FROM gl LEFT JOIN ct ON ct.grid_point_id = gl.grid_point_id),
applied AS (SELECT o.grid_point_id, o.observed_at, CASE WHEN f.grid_point_id IS NULL THEN o.aqi ELSE f.aqi END AS aqi,
                   o.pm25, o.pm10, CASE WHEN f.grid_point_id IS NULL THEN o.source_code ELSE f.source_code END AS source_code,
                   CASE WHEN f.grid_point_id IS NULL THEN o.confidence_score ELSE f.confidence_score END AS confidence_score
            FROM gobs o LEFT JOIN fz f ON f.grid_point_id = o.grid_point_id AND f.observed_at = o.observed_at)"""

SQL["grid_lattice"] = with_binding(f"""{GRID.strip()}
SELECT CAST(p.grid_point_id AS BIGINT) AS grid_point_id, p.lat, p.lng, p.province_code,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_obs
FROM pts p LEFT JOIN (SELECT grid_point_id, count(*) AS n FROM gobs GROUP BY 1) c ON c.grid_point_id = p.grid_point_id
""")

SQL["grid_fusion"] = with_binding(f"""{GRID.strip()}
SELECT CAST(grid_point_id AS BIGINT) AS grid_point_id, {ts_sql('observed_at')} AS observed_at, CAST(base_aqi AS BIGINT) AS base_aqi,
       CAST(aqi AS BIGINT) AS aqi, confidence_score, source_code, CAST(source_count AS BIGINT) AS source_count
FROM fz
""")

# a second run starts from the same baseline, so its rows are those of the first
SQL["grid_fusion_twice"] = SQL["grid_fusion"]

SQL["grid_fusion_any_source"] = with_binding(f"""{GRID.strip()},
gl2 AS (SELECT g.grid_point_id, g.observed_at, g.aqi, p.lat, p.lng FROM
          (SELECT *, row_number() OVER (PARTITION BY grid_point_id ORDER BY observed_at DESC) AS rn FROM applied
           WHERE {window_sql(AS_OF, '24 HOUR')} AND aqi IS NOT NULL) g JOIN pts p ON p.grid_point_id = g.grid_point_id WHERE rn = 1),
pr2 AS (SELECT g.grid_point_id, sl.aqi AS s_aqi, {hav_sql('g.lat', 'g.lng', 'sl.lat', 'sl.lng')} AS d FROM gl2 g, sl),
ct2 AS (SELECT grid_point_id, sum(s_aqi * w) AS ws, sum(w) AS tw, count(*) AS n FROM
          (SELECT *, CASE WHEN d < 0.1 THEN 100.0 ELSE 3.0 / (d * d) END AS w FROM pr2 WHERE d < 30) GROUP BY 1)
SELECT CAST(g.grid_point_id AS BIGINT) AS grid_point_id, {ts_sql('g.observed_at')} AS observed_at, CAST(g.aqi AS BIGINT) AS base_aqi,
       CAST(round_even((g.aqi * 1.0 + coalesce(c.ws, 0)) / (1.0 + coalesce(c.tw, 0)), 0) AS BIGINT) AS aqi,
       round_even(least(1.0, (1.0 + coalesce(c.tw, 0)) / 3.0), 2) AS confidence_score,
       CASE WHEN coalesce(c.n, 0) > 0 THEN 'fused' ELSE 'openmeteo' END AS source_code, CAST(coalesce(c.n, 0) + 1 AS BIGINT) AS source_count
FROM gl2 g LEFT JOIN ct2 c ON c.grid_point_id = g.grid_point_id
""")

SQL["grid_latest"] = with_binding(f"""{GRID.strip()},
pin AS (SELECT * FROM pts WHERE lat BETWEEN 10.0 AND 20.0 AND lng BETWEEN 103.0 AND 108.0),
lt AS (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY grid_point_id ORDER BY observed_at DESC) AS rn
                      FROM applied a WHERE {window_sql(AS_OF, '12 HOUR')}) WHERE rn = 1)
SELECT CAST(p.grid_point_id AS BIGINT) AS grid_point_id, p.lat, p.lng, p.province_code, p.province_name,
       {ts_sql('lt.observed_at')} AS observed_at, CAST(lt.aqi AS BIGINT) AS aqi, round(lt.pm25, 4) AS pm25, round(lt.pm10, 4) AS pm10,
       lt.source_code, lt.confidence_score
FROM pin p JOIN lt ON lt.grid_point_id = p.grid_point_id WHERE lt.aqi IS NOT NULL
""")

SQL["grid_stats"] = with_binding(f"""{GRID.strip()}
SELECT source_code, CAST(count(*) AS BIGINT) AS n, {ts_sql('min(observed_at)')} AS first_at, {ts_sql('max(observed_at)')} AS last_at,
       CAST((SELECT count(*) FROM pts) AS BIGINT) AS total_grid_points,
       CAST((SELECT count(DISTINCT grid_point_id) FROM applied WHERE {window_sql(AS_OF, '6 HOUR')}) AS BIGINT) AS fresh_within_6h
FROM applied WHERE observed_at <= {AS_OF} GROUP BY source_code
""")

SQL["grid_health"] = with_binding(f"""{GRID.strip()},
lt AS (SELECT grid_point_id, max(observed_at) AS last_at FROM applied WHERE observed_at <= {AS_OF} GROUP BY 1),
st AS (SELECT CASE WHEN lt.last_at IS NULL THEN 'no_data'
                   WHEN date_diff('microsecond', lt.last_at, {AS_OF}) / 3.6e9 < 6 THEN 'fresh'
                   WHEN date_diff('microsecond', lt.last_at, {AS_OF}) / 3.6e9 < 24 THEN 'stale' ELSE 'expired' END AS status
       FROM pts p LEFT JOIN lt ON lt.grid_point_id = p.grid_point_id)
SELECT CAST(count(*) FILTER (WHERE status = 'fresh') AS BIGINT) AS fresh, CAST(count(*) FILTER (WHERE status = 'stale') AS BIGINT) AS stale,
       CAST(count(*) FILTER (WHERE status = 'expired') AS BIGINT) AS expired, CAST(count(*) FILTER (WHERE status = 'no_data') AS BIGINT) AS no_data,
       CAST(count(*) AS BIGINT) AS total
FROM st
""")

_VI_FROM = ("àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ")
_VI_TO = ("aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd")

NATION_VERTICES = """
nat AS (SELECT n_nationkey, n_name, n_regionkey,
               row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation),
base AS (SELECT CAST(n_nationkey AS INT) AS polygon_id, n_name AS name, CAST(n_nationkey AS INT) AS sort_order, k,
                8.5::DOUBLE + n_regionkey * 3.2::DOUBLE AS y0, 8.5::DOUBLE + (n_regionkey + 1) * 3.2::DOUBLE AS y1,
                102.1::DOUBLE + k * 1.6::DOUBLE AS x0, 103.7::DOUBLE + k * 1.6::DOUBLE AS x1
         FROM nat),
verts AS (
  SELECT polygon_id, 0 AS ring, 0 AS seq, x0 AS lng, y0 AS lat FROM base UNION ALL
  SELECT polygon_id, 0, 1, x1, y0 FROM base UNION ALL
  SELECT polygon_id, 0, 2, x1 + 0.3::DOUBLE, y1 FROM base UNION ALL
  SELECT polygon_id, 0, 3, x0 + 0.3::DOUBLE, y1 FROM base UNION ALL
  SELECT polygon_id, 1, 0, x0 + 0.4::DOUBLE, y0 + 1.0::DOUBLE FROM base WHERE k = 0 UNION ALL
  SELECT polygon_id, 1, 1, x0 + 1.1::DOUBLE, y0 + 1.0::DOUBLE FROM base WHERE k = 0 UNION ALL
  SELECT polygon_id, 1, 2, x0 + 1.1::DOUBLE, y0 + 2.0::DOUBLE FROM base WHERE k = 0 UNION ALL
  SELECT polygon_id, 1, 3, x0 + 0.4::DOUBLE, y0 + 2.0::DOUBLE FROM base WHERE k = 0)
"""

SQL["grid_provinces"] = with_binding(f"""{GRID.strip()},
{NATION_VERTICES.strip()},
edges AS (SELECT polygon_id, lng AS x1, lat AS y1,
                 coalesce(lead(lng) OVER w, first_value(lng) OVER w) AS x2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2
          FROM verts WINDOW w AS (PARTITION BY polygon_id, ring ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
seen AS (SELECT p.* FROM pts p WHERE p.grid_point_id IN (SELECT grid_point_id FROM gobs)),
par AS (SELECT s.grid_point_id, e.polygon_id,
               sum(CASE WHEN ((e.y1 > s.lat) <> (e.y2 > s.lat)) AND s.lng < (e.x2 - e.x1) * (s.lat - e.y1) / (e.y2 - e.y1) + e.x1
                        THEN 1 ELSE 0 END) AS c
        FROM seen s, edges e GROUP BY 1, 2),
ins AS (SELECT par.grid_point_id, b.polygon_id, b.name,
               row_number() OVER (PARTITION BY par.grid_point_id ORDER BY b.sort_order, b.polygon_id) AS r
        FROM par JOIN base b ON b.polygon_id = par.polygon_id WHERE par.c % 2 = 1)
SELECT CAST(grid_point_id AS BIGINT) AS grid_point_id, CAST(polygon_id AS BIGINT) AS polygon_id, name AS province_name,
       regexp_replace(translate(lower(name), '{_VI_FROM}', '{_VI_TO}'), '[^a-z0-9]', '', 'g') AS province_code
FROM ins WHERE r = 1
""")

# polygons of the landed collections are numbered by region, then nation
_NUMBERED = "(SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS place FROM nation)"
SQL["geojson_polygons"] = f"""
WITH {NATION_VERTICES.strip()}
SELECT CAST(p.place AS BIGINT) AS polygon_id, b.name, CAST(v.ring AS BIGINT) AS ring, CAST(v.seq AS BIGINT) AS seq, v.lng, v.lat
FROM verts v JOIN base b ON b.polygon_id = v.polygon_id JOIN {_NUMBERED} p ON p.n_nationkey = v.polygon_id
"""
SQL["geojson_provinces"] = f"""
SELECT g.grid_point_id, CAST(p.place AS BIGINT) AS polygon_id, g.province_name
FROM ({SQL['grid_provinces'].strip()}) g JOIN {_NUMBERED} p ON p.n_nationkey = g.polygon_id
"""


def hourly_sql(metric: str, days: int) -> str:
    return (f"SELECT station_id, date_trunc('hour', observed_at) AS ts, avg(CAST({metric} AS DOUBLE)) AS y FROM aq "
            f"WHERE {window_sql(AS_OF, f'{days} DAY')} AND {ACTIVE} AND {metric} IS NOT NULL GROUP BY 1, 2")


def raw_sql(metric: str, days: int) -> str:
    return (f"SELECT station_id, obs_id, observed_at, CAST({metric} AS DOUBLE) AS y FROM aq "
            f"WHERE {window_sql(AS_OF, f'{days} DAY')} AND {ACTIVE} AND {metric} IS NOT NULL")


SQL["hourly_resample"] = with_binding(f"""
h AS ({hourly_sql('pm25', 14)})
SELECT CAST(station_id AS BIGINT) AS station_id, {ts_sql('ts')} AS ts, round(y, 4) AS y FROM h
""")

SQL["forecast_features"] = with_binding(f"""
h AS ({hourly_sql('aqi', 14)}),
f AS (
  SELECT station_id, ts, y, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week,
         avg(y) OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rm6,
         coalesce(stddev_samp(y) OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) AS rs6,
         avg(y) OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS rm24,
         lag(y, 1) OVER (PARTITION BY station_id ORDER BY ts) AS l1, lag(y, 24) OVER (PARTITION BY station_id ORDER BY ts) AS l24,
         first_value(y) OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fy,
         count(*) OVER (PARTITION BY station_id) AS n
  FROM h)
SELECT CAST(station_id AS BIGINT) AS station_id, {ts_sql('ts')} AS ts, round(y, 4) AS y, CAST(hour AS BIGINT) AS hour,
       CAST(day_of_week AS BIGINT) AS day_of_week,
       round(sin(2 * pi() * hour / 24), 4) + 0.0 AS hour_sin, round(cos(2 * pi() * hour / 24), 4) + 0.0 AS hour_cos,
       round(sin(2 * pi() * day_of_week / 7), 4) + 0.0 AS dow_sin, round(cos(2 * pi() * day_of_week / 7), 4) + 0.0 AS dow_cos,
       round(rm6, 4) AS rolling_mean_6h, round(rs6, 4) AS rolling_std_6h, round(rm24, 4) AS rolling_mean_24h,
       round(coalesce(l1, CASE WHEN n > 1 THEN fy END, 0), 4) AS lag_1h, round(coalesce(l24, CASE WHEN n > 24 THEN fy END, 0), 4) AS lag_24h
FROM f
""")

SQL["forecast_evaluation"] = with_binding(f"""
h AS ({hourly_sql('aqi', 14)}),
p AS (SELECT a.station_id, a.y AS actual, b.y AS predicted FROM h a JOIN h b ON b.station_id = a.station_id AND b.ts + INTERVAL 24 HOUR = a.ts)
SELECT CAST(station_id AS BIGINT) AS station_id, CAST(count(*) AS BIGINT) AS n, round_even(avg(abs(actual - predicted)), 3) AS mae,
       round_even(sqrt(avg((actual - predicted) * (actual - predicted))), 3) AS rmse,
       round_even(avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100, 3) AS mape
FROM p GROUP BY station_id
""")

# The normal equations by elimination (k-th step clears column k), then the forecast hour by hour.
_LINEAR = f"""
h AS ({hourly_sql('aqi', 14)}),
f AS (
  SELECT station_id, ts, y, hour(ts) AS hr, isodow(ts) - 1 AS dow,
         avg(y) OVER w6 AS rm6, coalesce(stddev_samp(y) OVER w6, 0) AS rs6,
         avg(y) OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS rm24,
         lag(y, 1) OVER (PARTITION BY station_id ORDER BY ts) AS l1, lag(y, 24) OVER (PARTITION BY station_id ORDER BY ts) AS l24,
         first_value(y) OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fy,
         row_number() OVER (PARTITION BY station_id ORDER BY ts) AS pos, count(*) OVER (PARTITION BY station_id) AS n
  FROM h WINDOW w6 AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
x AS (
  SELECT station_id, ts, pos, n, y, pos <= floor(n * 0.8) AS is_early,
         [1.0, hr, dow, sin(2 * pi() * hr / 24), cos(2 * pi() * hr / 24), sin(2 * pi() * dow / 7), cos(2 * pi() * dow / 7),
          rm6, rs6, rm24, coalesce(l1, fy), coalesce(l24, fy), y]::DOUBLE[] AS v
  FROM f WHERE n >= 48),
g AS (
  SELECT station_id, part, i, j, sum(v[i] * v[j]) AS s
  FROM x, range(0, 2) p(part), range(1, 13) a(i), range(1, 14) b(j) WHERE part = 1 OR is_early GROUP BY ALL),
m AS (SELECT station_id, part, list(line ORDER BY i) AS m
      FROM (SELECT station_id, part, i, list(s ORDER BY j) AS line FROM g GROUP BY ALL) GROUP BY ALL),
gj AS (
  SELECT station_id, part, 1 AS k, m FROM m
  UNION ALL
  SELECT station_id, part, k + 1,
         list_transform(range(1, 13), lambda i: list_transform(range(1, 14), lambda j:
           CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))
  FROM gj WHERE k <= 12),
b AS (SELECT station_id, part, list_transform(m, lambda line: line[13]) AS beta FROM gj WHERE k = 13),
e AS (
  SELECT x.station_id, any_value(n) AS n, max(ts) AS last_ts, stddev_pop(y - list_dot_product(b1.beta, v[1:12])) AS spread,
         list(y ORDER BY pos) FILTER (WHERE pos > n - 24) AS tail, any_value(b1.beta) AS beta,
         round_even(avg(abs(y - list_dot_product(b0.beta, v[1:12]))) FILTER (WHERE NOT is_early), 3) AS mae,
         round_even(sqrt(avg(pow(y - list_dot_product(b0.beta, v[1:12]), 2)) FILTER (WHERE NOT is_early)), 3) AS rmse,
         round_even(100 * avg(abs((y - list_dot_product(b0.beta, v[1:12])) / y)) FILTER (WHERE NOT is_early AND y <> 0), 3) AS mape
  FROM x JOIN b b0 ON b0.station_id = x.station_id AND b0.part = 0 JOIN b b1 ON b1.station_id = x.station_id AND b1.part = 1
  GROUP BY x.station_id)"""

_COEFFICIENTS = ["intercept", "hour", "day_of_week", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "rolling_mean_6h", "rolling_std_6h",
                 "rolling_mean_24h", "lag_1h", "lag_24h"]

SQL["forecast_linear_model"] = with_binding(f"""{_LINEAR}
SELECT CAST(station_id AS BIGINT) AS station_id, CAST(n AS BIGINT) AS training_rows, mae, rmse, mape, round_even(spread, 4) AS spread,
       {', '.join(f'round_even(beta[{i}], 4) AS {c}' for i, c in enumerate(_COEFFICIENTS, 1))}
FROM e
""").replace("WITH ", "WITH RECURSIVE ", 1)

SQL["forecast_linear"] = with_binding(f"""{_LINEAR},
r AS (
  SELECT station_id, 0 AS step, tail, beta, last_ts AS ts, CAST(NULL AS DOUBLE) AS value FROM e
  UNION ALL
  SELECT station_id, step + 1, list_append(tail[2:24], next), beta, t, next
  FROM (SELECT station_id, step, tail, beta, t, greatest(0, list_dot_product(beta, [
                 1.0, hour(t), isodow(t) - 1, sin(2 * pi() * hour(t) / 24), cos(2 * pi() * hour(t) / 24),
                 sin(2 * pi() * (isodow(t) - 1) / 7), cos(2 * pi() * (isodow(t) - 1) / 7),
                 list_avg(tail[19:24]), list_stddev_pop(tail[19:24]), list_avg(tail), tail[24], tail[1]]::DOUBLE[])) AS next
        FROM (SELECT *, ts + INTERVAL 1 HOUR AS t FROM r WHERE step < 24)))
SELECT 'linear-' || e.station_id || '-20240131000000' AS run_id, CAST(e.station_id AS BIGINT) AS station_id, 'linear' AS model_type,
       'aqi' AS target_metric, CAST(24 AS BIGINT) AS horizon_hours, CAST(n AS BIGINT) AS training_rows, 'success' AS status,
       CAST(NULL AS VARCHAR) AS error_message, mae, rmse, mape, CAST(step AS BIGINT) AS step, round_even(value, 2) AS predicted_value,
       round_even(greatest(value - 1.96 * spread * (1 + 0.05 * (step - 1)), 0), 2) AS lower_bound,
       round_even(value + 1.96 * spread * (1 + 0.05 * (step - 1)), 2) AS upper_bound,
       {ts_sql('r.ts')} AS predicted_at, {ts_sql(AS_OF)} AS created_at
FROM e JOIN r ON r.station_id = e.station_id WHERE step > 0
""").replace("WITH ", "WITH RECURSIVE ", 1)


def _r4_all(cols):
    return ", ".join(f"round({c}, 4) + 0.0 AS {c.split('.')[-1]}" for c in cols)


_WXF = ["temperature_c", "humidity_pct", "wind_speed_mps", "pressure_hpa", "precipitation_mm", "cloud_cover_pct"]

SQL["knn_training_features"] = with_binding(f"""
ah AS (SELECT a.station_id, date_trunc('hour', a.observed_at) AS ts, avg(CAST(a.aqi AS DOUBLE)) AS aqi
       FROM aq a WHERE {window_sql(AS_OF, '30 DAY')} AND {ACTIVE} AND aqi IS NOT NULL GROUP BY 1, 2),
ahs AS (SELECT ah.*, s.lat, s.lng FROM ah JOIN stations s ON s.station_id = ah.station_id),
wh AS (SELECT station_id, date_trunc('hour', observed_at) AS ts, {', '.join(f'avg({c}) AS {c}' for c in _WXF)}
       FROM wx WHERE {window_sql(AS_OF, '30 DAY')} GROUP BY 1, 2),
pr AS (SELECT a.station_id, a.ts, b.aqi AS r_aqi, {hav_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS d, b.station_id AS rid
       FROM ahs a JOIN ahs b ON a.ts = b.ts AND a.station_id <> b.station_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY station_id, ts ORDER BY d, rid) AS r FROM pr),
nb AS (SELECT station_id, ts, avg(r_aqi) AS neighbor_aqi_mean, avg(d) AS neighbor_dist_mean, CAST(count(*) AS DOUBLE) AS neighbor_count
       FROM rk WHERE r <= 3 GROUP BY 1, 2)
SELECT CAST(a.station_id AS BIGINT) AS station_id, {ts_sql('a.ts')} AS ts, round(a.lat, 4) AS lat, round(a.lng, 4) AS lng,
       round(sin(2 * pi() * hour(a.ts) / 24), 4) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(a.ts) / 24), 4) + 0.0 AS hour_cos,
       round(CAST(isodow(a.ts) - 1 AS DOUBLE), 4) AS dow, round(CAST(month(a.ts) AS DOUBLE), 4) AS month,
       {_r4_all([f'w.{c}' for c in _WXF])}, round(nb.neighbor_aqi_mean, 4) AS neighbor_aqi_mean,
       round(nb.neighbor_dist_mean, 4) AS neighbor_dist_mean, round(coalesce(nb.neighbor_count, 0.0), 4) AS neighbor_count, round(a.aqi, 4) AS aqi
FROM ahs a LEFT JOIN wh w ON w.station_id = a.station_id AND w.ts = a.ts
LEFT JOIN nb ON nb.station_id = a.station_id AND nb.ts = a.ts
""")

_FOLD_SIZES = f"""
ah AS (SELECT a.station_id, date_trunc('hour', a.observed_at) AS ts FROM aq a
       WHERE {window_sql(AS_OF, '30 DAY')} AND {ACTIVE} AND aqi IS NOT NULL GROUP BY 1, 2),
sizes AS (SELECT ah.station_id, count(*) AS n FROM ah JOIN stations s ON s.station_id = ah.station_id GROUP BY 1),
total AS (SELECT CAST(least(5, count(*)) AS INT) AS k, CAST(sum(n) AS BIGINT) AS train_rows FROM sizes)"""

# one step for each station: it goes to the first of the lightest folds
SQL["grid_ml_folds"] = with_binding(f"""{_FOLD_SIZES.strip()},
ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, station_id) AS r FROM sizes),
dealt AS (
  WITH RECURSIVE step(r, station_id, n, fold, load) AS (
    SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), 0, list_transform(range(0, k), lambda x: CAST(0 AS BIGINT)) FROM total
    UNION ALL
    SELECT q.r, CAST(q.station_id AS BIGINT), CAST(q.n AS BIGINT), CAST(list_position(s.load, list_min(s.load)) AS INT) - 1,
           list_transform(s.load, lambda x, i: CASE WHEN i = list_position(s.load, list_min(s.load)) THEN x + CAST(q.n AS BIGINT) ELSE x END)
    FROM step s JOIN ranked q ON q.r = s.r + 1)
  SELECT * FROM step WHERE r > 0)
SELECT station_id, n, CAST(fold AS BIGINT) AS fold, CAST(k AS BIGINT) AS k FROM dealt, total
""")

SQL["grid_ml_promotion"] = with_binding(f"""{_FOLD_SIZES.strip()}
SELECT CAST(run AS BIGINT) AS run, 'group_kfold_' || k AS cv_kind, CAST(k AS BIGINT) AS folds, train_rows AS sample_count, run = 1 AS promoted,
       CASE WHEN run = 2 THEN true END AS against_stored
FROM total, (VALUES (1), (2)) AS runs(run)
""")

SQL["knn_inference_features"] = with_binding(f"""
pts AS (SELECT CAST(i * 41 + j AS INT) AS grid_point_id, round(8.4::DOUBLE + 0.2::DOUBLE * i, 5) AS lat,
               round(102::DOUBLE + 0.2::DOUBLE * j, 5) AS lng FROM range(0, 77) a(i), range(0, 41) b(j)),
sa AS (SELECT a.station_id, CAST(a.aqi AS DOUBLE) AS aqi, s.lat, s.lng FROM
         (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC, obs_id DESC) AS rn FROM aq
          WHERE {window_sql(AS_OF, '6 HOUR')} AND aqi IS NOT NULL AND {ACTIVE}) a
         JOIN stations s ON s.station_id = a.station_id WHERE rn = 1),
sw AS (SELECT w.*, s.lat, s.lng FROM
         (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC, obs_id DESC) AS rn FROM wx
          WHERE {window_sql(AS_OF, '6 HOUR')}) w
         JOIN stations s ON s.station_id = w.station_id WHERE rn = 1),
pa AS (SELECT p.grid_point_id, sa.aqi, {hav_sql('p.lat', 'p.lng', 'sa.lat', 'sa.lng')} AS d, sa.station_id AS rid FROM pts p, sa),
na AS (SELECT grid_point_id, avg(aqi) AS neighbor_aqi_mean, avg(d) AS neighbor_dist_mean, CAST(count(*) AS DOUBLE) AS neighbor_count
       FROM (SELECT *, row_number() OVER (PARTITION BY grid_point_id ORDER BY d, rid) AS r FROM pa) WHERE r <= 3 GROUP BY 1),
pw AS (SELECT p.grid_point_id, {', '.join(f'sw.{c}' for c in _WXF)}, {hav_sql('p.lat', 'p.lng', 'sw.lat', 'sw.lng')} AS d, sw.station_id AS rid
       FROM pts p, sw),
nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_point_id ORDER BY d, rid) AS r FROM pw) WHERE r = 1)
SELECT CAST(p.grid_point_id AS BIGINT) AS grid_point_id, round(p.lat, 4) AS lat, round(p.lng, 4) AS lng,
       round(sin(2 * pi() * hour({AS_OF}) / 24), 4) + 0.0 AS hour_sin, round(cos(2 * pi() * hour({AS_OF}) / 24), 4) + 0.0 AS hour_cos,
       round(CAST(isodow({AS_OF}) - 1 AS DOUBLE), 4) AS dow, round(CAST(month({AS_OF}) AS DOUBLE), 4) AS month,
       {_r4_all([f'nw.{c}' for c in _WXF])}, round(na.neighbor_aqi_mean, 4) AS neighbor_aqi_mean,
       round(na.neighbor_dist_mean, 4) AS neighbor_dist_mean, round(coalesce(na.neighbor_count, 0.0), 4) AS neighbor_count
FROM pts p LEFT JOIN na ON na.grid_point_id = p.grid_point_id LEFT JOIN nw ON nw.grid_point_id = p.grid_point_id
""")


SQL["payload_normalise"] = with_binding(f"""
SELECT CAST(event_id AS BIGINT) AS payload_id, CAST(((event_id * 7919) % 3157 + 3157) % 3157 AS BIGINT) AS grid_point_id,
       {ts_sql("CASE WHEN event_id % 19 = 0 THEN ts ELSE date_trunc('hour', ts) END")} AS observed_at, CAST(round_even(value, 0) AS BIGINT) AS aqi,
       round(value * 0.4, 4) AS pm25, CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value * 0.8, 4) END AS pm10,
       round(k * 0.5, 4) AS no2, CASE WHEN event_id % 13 = 0 THEN NULL ELSE round(k, 4) END AS o3,
       round(value * 0.1, 4) AS so2, 250.0::DOUBLE AS co, 'openmeteo' AS source_code, 0.6::DOUBLE AS confidence_score,
       {ts_sql('ts')} AS fetched_at
FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events) e
WHERE event_type <> 'error' AND value IS NOT NULL
""")


def pm25_aqi_sql(x: str, strict: bool) -> str:
    from .config import PM25_BREAKPOINTS

    c = x if strict else f"(floor({x} * 10) / 10)"
    parts = [f"WHEN {x} IS NULL OR isnan({x}) OR {x} < 0 THEN NULL"]
    for c_lo, c_hi, i_lo, i_hi in PM25_BREAKPOINTS:
        slope = repr((i_hi - i_lo) / (c_hi - c_lo))
        parts.append(f"WHEN {c} >= {c_lo!r}::DOUBLE AND {c} <= {c_hi!r}::DOUBLE THEN "
                     f"CAST(round_even({slope}::DOUBLE * ({c} - {c_lo!r}::DOUBLE) + {i_lo}, 0) AS INT)")
    parts.append(f"WHEN {x} > 500.4::DOUBLE THEN 500")
    return "CASE " + " ".join(parts) + " ELSE NULL END"


SQL["pm25_to_aqi"] = with_binding(f"""
SELECT CAST(obs_id AS BIGINT) AS obs_id, round(pm25, 4) AS pm25, CAST({pm25_aqi_sql('pm25', False)} AS BIGINT) AS aqi_epa,
       CAST({pm25_aqi_sql('pm25', True)} AS BIGINT) AS aqi_strict
FROM aq
""")

SQL["raster_nearest"] = with_binding(f"""{GRID.strip()},
ras AS (SELECT round(8.3::DOUBLE + ci * 0.5::DOUBLE, 5) AS r_lat, round(101.3::DOUBLE + cj * 0.5::DOUBLE, 5) AS r_lon, avg(pm25) AS pm25
        FROM (SELECT rd.pm25, CAST(floor((p.lat - {repr(8.3 - 0.25)}::DOUBLE) / 0.5::DOUBLE) AS INT) AS ci,
                     CAST(floor((p.lng - {repr(101.3 - 0.25)}::DOUBLE) / 0.5::DOUBLE) AS INT) AS cj
              FROM rd JOIN pts p ON p.grid_point_id = rd.grid_point_id) GROUP BY ci, cj),
la AS (SELECT DISTINCT r_lat FROM ras), lo AS (SELECT DISTINCT r_lon FROM ras),
nla AS (SELECT * FROM (SELECT p.grid_point_id, la.r_lat, row_number() OVER (PARTITION BY p.grid_point_id ORDER BY abs(p.lat - la.r_lat), la.r_lat DESC) AS r
                       FROM pts p, la) WHERE r = 1),
nlo AS (SELECT * FROM (SELECT p.grid_point_id, lo.r_lon, row_number() OVER (PARTITION BY p.grid_point_id ORDER BY abs(p.lng - lo.r_lon), lo.r_lon DESC) AS r
                       FROM pts p, lo) WHERE r = 1),
j AS (SELECT nla.grid_point_id, ras.pm25 FROM nla JOIN nlo ON nlo.grid_point_id = nla.grid_point_id
      JOIN ras ON ras.r_lat = nla.r_lat AND ras.r_lon = nlo.r_lon),
a AS (SELECT *, {pm25_aqi_sql('pm25', False)} AS aqi FROM j)
SELECT CAST(grid_point_id AS BIGINT) AS grid_point_id, {ts_sql(f"date_trunc('hour', {AS_OF})")} AS observed_at, CAST(aqi AS BIGINT) AS aqi,
       round(pm25, 4) AS pm25, 'berkeley_earth' AS source_code, 0.7::DOUBLE AS confidence_score
FROM a WHERE aqi IS NOT NULL
""")

_SPLIT = "TIMESTAMP '2024-01-15 00:00:00'"
_READ_COLS = "reading_id, grid_point_id, observed_at, aqi, pm25, pm10, source_code, confidence_score, fetched_at"

SQL["keyed_merge"] = with_binding(f"""{GRID.strip()},
ex AS (SELECT {_READ_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY grid_point_id, observed_at ORDER BY fetched_at DESC, reading_id DESC) AS rn
                                 FROM rd WHERE fetched_at < {_SPLIT}) WHERE rn = 1),
u AS (SELECT {_READ_COLS}, 0 AS src, 0 AS seq FROM ex UNION ALL SELECT {_READ_COLS}, 1 AS src, reading_id AS seq FROM rd WHERE fetched_at >= {_SPLIT}),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_point_id, observed_at ORDER BY src DESC, seq DESC) AS rn FROM u) WHERE rn = 1)
SELECT CAST(reading_id AS BIGINT) AS reading_id, CAST(grid_point_id AS BIGINT) AS grid_point_id, {ts_sql('observed_at')} AS observed_at,
       CAST(aqi AS BIGINT) AS aqi, round(pm25, 4) AS pm25, round(pm10, 4) AS pm10, source_code, confidence_score, {ts_sql('fetched_at')} AS fetched_at
FROM m
""")

SQL["insert_ignore"] = with_binding(f"""{GRID.strip()},
ex AS (SELECT DISTINCT grid_point_id, observed_at FROM rd WHERE fetched_at < {_SPLIT}),
nw AS (SELECT * FROM rd WHERE fetched_at >= {_SPLIT} AND NOT EXISTS
         (SELECT 1 FROM ex WHERE ex.grid_point_id = rd.grid_point_id AND ex.observed_at = rd.observed_at)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_point_id, observed_at ORDER BY reading_id) AS rn FROM nw) WHERE rn = 1)
SELECT CAST(reading_id AS BIGINT) AS reading_id, CAST(grid_point_id AS BIGINT) AS grid_point_id, {ts_sql('observed_at')} AS observed_at,
       CAST(aqi AS BIGINT) AS aqi, round(pm25, 4) AS pm25, round(pm10, 4) AS pm10, source_code, confidence_score, {ts_sql('fetched_at')} AS fetched_at
FROM m
""")


def _quality_sql() -> str:
    from .operators.quality import RULES

    parts = []
    for t, rule, col, lo, hi in RULES:
        src = "aq" if t == "air_quality" else "wx"
        bad = f"CAST({col} AS DOUBLE) < {lo}" if hi is None else f"(CAST({col} AS DOUBLE) < {lo} OR CAST({col} AS DOUBLE) > {hi})"
        parts.append(f"SELECT '{t}' AS table_name, '{rule}' AS rule, CAST(count({col}) AS BIGINT) AS checked, "
                     f"CAST(count(*) FILTER (WHERE {bad}) AS BIGINT) AS failed, "
                     f"CAST(count({col}) - count(*) FILTER (WHERE {bad}) AS BIGINT) AS passed FROM {src}")
    return "\nUNION ALL ".join(parts)


def _rejects_sql() -> str:
    from .operators.quality import RULES

    parts = []
    for t, rule, col, lo, hi in RULES:
        src, v = ("aq" if t == "air_quality" else "wx"), f"CAST({col} AS DOUBLE)"
        bad = f"{v} < {lo}" if hi is None else f"({v} < {lo} OR {v} > {hi})"
        parts.append(f"SELECT CAST(obs_id AS BIGINT) AS id, '{t}' AS table_name, '{rule}' AS rule, {v} AS value FROM {src} WHERE {bad}")
    return "\nUNION ALL ".join(parts)


SQL["quality_rejects"] = with_binding("q AS (" + _rejects_sql() + ")\nSELECT * FROM q")

SQL["quality_filter"] = with_binding("q AS (" + _quality_sql() + ")\nSELECT * FROM q")


LINEAGE = """
req AS (SELECT raw_payload_id AS request_id, pipeline_run_id, provider_code, endpoint_code,
               CASE WHEN min(obs_id) % 17 = 0 THEN 'failed' WHEN min(obs_id) % 29 = 0 THEN 'timeout' ELSE 'success' END AS status,
               min(fetched_at) AS request_started_at, count(*) AS records, CAST(((sum(obs_id) % 997) + 997) % 997 + 20 AS INT) AS latency_ms,
               CAST(count(*) * 512 AS INT) AS response_size_bytes
        FROM aq GROUP BY raw_payload_id, pipeline_run_id, provider_code, endpoint_code),
runs AS (SELECT pipeline_run_id, provider_code || '_ingest' AS pipeline_code, provider_code, endpoint_code,
                CASE WHEN sum(CASE WHEN status <> 'success' THEN 1 ELSE 0 END) = 0 THEN 'success'
                     WHEN sum(CASE WHEN status <> 'success' THEN 1 ELSE 0 END) < count(*) THEN 'partial' ELSE 'failed' END AS status,
                min(request_started_at) AS started_at, max(request_started_at) AS finished_at, sum(records) AS records,
                count(*) AS requests, count(*) FILTER (WHERE status <> 'success') AS bad
         FROM req GROUP BY pipeline_run_id, provider_code, endpoint_code),
eps AS (SELECT DISTINCT endpoint_code, provider_code, upper(provider_code) || ' hourly' AS endpoint_name, 'api' AS endpoint_kind FROM aq),
bnd AS (SELECT station_id, endpoint_code, provider_code, min(observed_at) AS valid_from FROM aq GROUP BY 1, 2, 3)"""

SQL["ingest_run_overview"] = with_binding(f"""{LINEAGE.strip()}
SELECT r.pipeline_run_id AS id, r.pipeline_code, upper(r.provider_code) || ' ingest' AS pipeline_name, 'ingest' AS pipeline_type,
       r.status, 'schedule' AS trigger_type, {ts_sql('r.started_at')} AS started_at, {ts_sql('r.finished_at')} AS finished_at,
       r.endpoint_code, e.endpoint_name, CAST(r.records AS BIGINT) AS records,
       CASE WHEN bad > 0 THEN bad || ' of ' || requests || ' requests failed' END AS error_summary,
       '{{"requests":' || requests || ',"failed_requests":' || bad || ',"records":' || records || '}}' AS metrics
FROM runs r LEFT JOIN eps e ON e.endpoint_code = r.endpoint_code
""")

SQL["cascade_delete"] = with_binding(f"""{LINEAGE.strip()}
SELECT request_id, pipeline_run_id, status, CAST(latency_ms AS BIGINT) AS latency_ms, CAST(records AS BIGINT) AS records
FROM req WHERE pipeline_run_id IN (SELECT pipeline_run_id FROM runs WHERE started_at > {AS_OF} - INTERVAL 7 DAY)
""")

SQL["lineage_observation"] = with_binding(f"""{LINEAGE.strip()}
SELECT a.raw_payload_id, a.normalize_run_id, a.pipeline_run_id, a.endpoint_code, a.provider_code, CAST(a.obs_id AS BIGINT) AS obs_id,
       CAST(a.station_id AS BIGINT) AS station_id, {ts_sql('a.observed_at')} AS observed_at, {ts_sql('a.fetched_at')} AS fetched_at,
       CAST(a.aqi AS BIGINT) AS aqi, s.code AS station_code, upper(a.provider_code) AS provider_name, e.endpoint_name,
       r.status AS run_status, {ts_sql('r.started_at')} AS run_started_at, q.request_id, q.status AS request_status,
       CAST(CASE WHEN q.status = 'success' THEN 200 ELSE 500 END AS BIGINT) AS http_status, CAST(q.latency_ms AS BIGINT) AS latency_ms,
       'aq_v1' AS parser_key, '1.0' AS parser_version
FROM aq a JOIN stations s ON s.station_id = a.station_id LEFT JOIN eps e ON e.endpoint_code = a.endpoint_code
LEFT JOIN runs r ON r.pipeline_run_id = a.pipeline_run_id
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY pipeline_run_id, endpoint_code ORDER BY request_started_at DESC, request_id DESC) AS rn
           FROM req) q ON q.pipeline_run_id = r.pipeline_run_id AND q.endpoint_code = e.endpoint_code AND q.rn = 1
""")

SQL["bindings_overview"] = with_binding(f"""{LINEAGE.strip()},
lt AS (SELECT * FROM (SELECT station_id, endpoint_code, observed_at, aqi,
                             row_number() OVER (PARTITION BY station_id, endpoint_code ORDER BY observed_at DESC, obs_id DESC) AS rn
                      FROM aq WHERE observed_at <= {AS_OF}) WHERE rn = 1)
SELECT CAST(s.station_id AS BIGINT) AS station_id, s.code AS station_code, s.is_active AS station_active,
       CAST(b.station_id AS VARCHAR) || ':' || b.endpoint_code AS binding_id, 'ext-' || CAST(b.station_id AS VARCHAR) AS external_object_id,
       CAST(CASE WHEN b.provider_code = 'waqi' THEN 200 ELSE 100 END AS BIGINT) AS priority, TRUE AS binding_enabled,
       {ts_sql('b.valid_from')} AS valid_from, e.provider_code, b.endpoint_code, e.endpoint_name, e.endpoint_kind,
       {ts_sql('lt.observed_at')} AS latest_observation_at, CAST(lt.aqi AS BIGINT) AS latest_aqi
FROM stations s LEFT JOIN bnd b ON b.station_id = s.station_id LEFT JOIN eps e ON e.endpoint_code = b.endpoint_code
LEFT JOIN lt ON lt.station_id = b.station_id AND lt.endpoint_code = b.endpoint_code
""")

SQL["provider_health"] = with_binding(f"""{LINEAGE.strip()},
st AS (SELECT provider_code, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS ok,
              count(*) FILTER (WHERE status IN ('failed', 'timeout')) AS bad, CAST(round(avg(latency_ms)) AS INT) AS avg_latency_ms,
              CAST(round(quantile_cont(latency_ms, 0.95)) AS INT) AS p95_latency_ms, sum(response_size_bytes) AS total_bytes_24h
       FROM req WHERE request_started_at > {AS_OF} - INTERVAL 24 HOUR AND request_started_at <= {AS_OF} GROUP BY 1),
act AS (SELECT provider_code, count(*) AS active_bindings FROM bnd GROUP BY 1),
lok AS (SELECT provider_code, max(request_started_at) AS last_success_at FROM req WHERE status = 'success' AND request_started_at <= {AS_OF} GROUP BY 1),
pv AS (SELECT DISTINCT provider_code FROM aq)
SELECT pv.provider_code, upper(pv.provider_code) AS provider_name, TRUE AS is_active, CAST(coalesce(st.total, 0) AS BIGINT) AS requests_24h,
       CAST(coalesce(st.ok, 0) AS BIGINT) AS success_24h, CAST(coalesce(st.bad, 0) AS BIGINT) AS failed_24h,
       CASE WHEN coalesce(st.total, 0) > 0 THEN round(st.ok / st.total * 100, 1) ELSE 0.0 END AS success_rate_pct,
       CAST(st.avg_latency_ms AS BIGINT) AS avg_latency_ms, CAST(st.p95_latency_ms AS BIGINT) AS p95_latency_ms,
       CAST(st.total_bytes_24h AS BIGINT) AS total_bytes_24h, CAST(coalesce(act.active_bindings, 0) AS BIGINT) AS active_bindings,
       {ts_sql('lok.last_success_at')} AS last_success_at
FROM pv LEFT JOIN st ON st.provider_code = pv.provider_code LEFT JOIN act ON act.provider_code = pv.provider_code
LEFT JOIN lok ON lok.provider_code = pv.provider_code
""")


def _sub(name: str) -> str:
    return "(" + SQL[name].strip() + ")"


SQL["api_daily_summaries"] = f"""
SELECT ds.*, s.code AS station_code FROM {_sub('daily_summary')} ds
JOIN (WITH {BINDING.strip()} SELECT * FROM stations) s ON s.station_id = ds.station_id
WHERE CAST(ds.summary_date AS DATE) > DATE '2024-01-01'
ORDER BY ds.summary_date DESC, s.code LIMIT 500
"""

SQL["daily_summary_yesterday"] = f"SELECT * FROM {_sub('daily_summary')} WHERE summary_date = '2024-01-30'"

SQL["api_latest_forecast"] = f"""
SELECT station_id, run_id, mae, step, predicted_at, predicted_value, lower_bound, upper_bound FROM {_sub('forecast_linear')}
"""

SQL["station_lineage"] = f"""
SELECT l.*, a.analysis_date, p.run_id, coalesce(p.prediction_count, 0) AS prediction_count, p.last_predicted_for, p.last_predicted_value
FROM {_sub('station_source_latest')} l
LEFT JOIN (SELECT station_id, max(summary_date) AS analysis_date FROM {_sub('daily_summary')} GROUP BY 1) a ON a.station_id = l.station_id
LEFT JOIN (SELECT station_id, run_id, CAST(count(*) AS BIGINT) AS prediction_count, max(predicted_at) AS last_predicted_for,
                  max_by(predicted_value, predicted_at) AS last_predicted_value
           FROM {_sub('forecast_linear')} GROUP BY 1, 2) p ON p.station_id = l.station_id
ORDER BY l.observed_at DESC NULLS LAST, l.station_code LIMIT 20
"""

SQL["api_anomalies"] = f"""
SELECT a.*, s.code AS station_code FROM {_sub('anomaly_candidates')} a
JOIN (WITH {BINDING.strip()} SELECT * FROM stations) s ON s.station_id = a.station_id
WHERE CAST(a.detected_at AS TIMESTAMP) > {AS_OF} - INTERVAL 7 DAY AND a.severity = 'warning'
ORDER BY a.detected_at DESC, a.station_id, a.metric, a.obs_id LIMIT 200
"""

SQL["api_health_all"] = f"""
SELECT h.*, s.code AS station_code FROM {_sub('health_impact')} h
JOIN (WITH {BINDING.strip()} SELECT * FROM stations) s ON s.station_id = h.station_id AND s.is_active
"""

SQL["stream_grid_ingest"] = with_binding(f"""{GRID.strip()}
SELECT CAST(reading_id AS BIGINT) AS reading_id, CAST(grid_point_id AS BIGINT) AS grid_point_id, {ts_sql('observed_at')} AS observed_at,
       CAST(aqi AS BIGINT) AS aqi, round(pm25, 4) AS pm25, round(pm10, 4) AS pm10, source_code, confidence_score, {ts_sql('fetched_at')} AS fetched_at
FROM gobs
""")

SQL["stream_hourly"] = with_binding(f"""
SELECT CAST(station_id AS BIGINT) AS station_id, {ts_sql("date_trunc('hour', observed_at)")} AS hour, round(avg(aqi), 4) AS aqi_avg,
       CAST(count(*) AS BIGINT) AS samples
FROM aq GROUP BY station_id, date_trunc('hour', observed_at)
""")

SQL["stream_hourly_windows"] = SQL["stream_hourly"]
SQL["stream_anomalies"] = SQL["anomaly_candidates"]
SQL["stream_anomalies_rescanned"] = SQL["anomaly_suppressed"]



SQL["run_all"] = f"""
SELECT 'daily_summary' AS job, CAST(count(*) AS BIGINT) AS processed FROM {_sub('daily_summary')}
UNION ALL SELECT 'anomalies', CAST(count(*) AS BIGINT) FROM {_sub('anomaly_candidates')}
UNION ALL SELECT 'seasonal', CAST(count(DISTINCT station_id) AS BIGINT) FROM {_sub('seasonal_peaks')}
UNION ALL SELECT 'correlation', CAST(count(DISTINCT station_id) AS BIGINT) FROM
  (SELECT station_id FROM {_sub('correlation_aq_aq')} UNION ALL SELECT station_id FROM {_sub('correlation_weather_hourly')})
UNION ALL SELECT 'trend', CAST(count(DISTINCT station_id) AS BIGINT) FROM {_sub('trend')}
UNION ALL SELECT 'health', CAST(count(DISTINCT station_id) AS BIGINT) FROM {_sub('health_impact')}
UNION ALL SELECT 'forecast_linear', CAST(count(*) AS BIGINT) FROM (WITH {BINDING.strip()} SELECT station_id FROM ({hourly_sql('aqi', 14)}) GROUP BY station_id HAVING count(*) >= 48)
UNION ALL SELECT 'forecast_arima', CAST(count(*) AS BIGINT) FROM (WITH {BINDING.strip()} SELECT station_id FROM ({hourly_sql('aqi', 7)}) GROUP BY station_id HAVING count(*) >= 48)
UNION ALL SELECT 'forecast_prophet', CAST(count(*) AS BIGINT) FROM (WITH {BINDING.strip()} SELECT station_id FROM ({raw_sql('aqi', 14)}) GROUP BY station_id HAVING count(*) >= 20)
"""


def _latest_sql(name: str, keys: str) -> str:
    prev = SQL[name].replace(AS_OF, "TIMESTAMP '2024-01-24 00:00:00'")
    return f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY analysis_date DESC) AS rn FROM (
    SELECT *, '2024-01-31' AS analysis_date FROM ({SQL[name].strip()})
    UNION ALL SELECT *, '2024-01-24' AS analysis_date FROM ({prev.strip()})))
WHERE rn = 1
"""


SQL["api_latest_trend"] = _latest_sql("trend", "station_id, metric")
SQL["api_latest_health"] = _latest_sql("health_impact", "station_id")


SQL["analysis_lineage"] = with_binding(f"""{LINEAGE.strip()},
ds AS (SELECT CAST(station_id AS INT) AS station_id, CAST(summary_date AS DATE) AS d FROM {_sub('daily_summary')}),
an AS (SELECT CAST(station_id AS INT) AS station_id, CAST(CAST(detected_at AS TIMESTAMP) AS DATE) AS d, count(*) AS n
       FROM {_sub('anomaly_candidates')} GROUP BY 1, 2),
feed AS (SELECT station_id, CAST(observed_at AS DATE) AS d, arg_max(pipeline_run_id, (fetched_at, obs_id)) AS pipeline_run_id
         FROM aq GROUP BY 1, 2)
SELECT 'daily-' || CAST(ds.station_id AS VARCHAR) || '-' || CAST(ds.d AS VARCHAR) AS analysis_run_id, 'daily_summary' AS analysis_type,
       'daily_summary' AS algorithm_key, '1' AS algorithm_version, CAST(ds.station_id AS BIGINT) AS station_id, s.code AS station_code,
       CAST(ds.d AS VARCHAR) AS period_from, CAST(ds.d + 1 AS VARCHAR) AS period_to, 'success' AS analysis_status,
       f.pipeline_run_id, r.pipeline_code, r.status AS pipeline_status, {ts_sql('r.started_at')} AS pipeline_started_at,
       {ts_sql('r.finished_at')} AS pipeline_finished_at, CAST(1 AS BIGINT) AS daily_summaries_count,
       CAST(coalesce(an.n, 0) AS BIGINT) AS anomalies_found, CAST(0 AS BIGINT) AS reports_generated
FROM ds JOIN feed f ON f.station_id = ds.station_id AND f.d = ds.d
LEFT JOIN stations s ON s.station_id = ds.station_id
JOIN runs r ON r.pipeline_run_id = f.pipeline_run_id
LEFT JOIN an ON an.station_id = ds.station_id AND an.d = ds.d
""")


SQL["top_provinces"] = f"""
SELECT province_name, CAST(count(*) AS BIGINT) AS n FROM {_sub('grid_provinces')}
GROUP BY province_name ORDER BY n DESC, province_name LIMIT 10
"""

_seasonal_latest = _latest_sql("seasonal_peaks", "station_id")
SQL["api_latest_seasonal"] = f"""
SELECT station_id AS stationId, metric, peak_hours AS peakHours, off_peak_hours AS offPeakHours, best_dow AS bestDow,
       worst_dow AS worstDow, overall_avg AS overallAvg, hourly_variation AS hourlyVariation, analysis_date AS analysisDate
FROM ({_seasonal_latest})
"""


def _corr_latest() -> str:
    cur = "(" + SQL["correlation_aq_aq"].strip() + ") UNION ALL (" + SQL["correlation_weather_hourly"].strip() + ")"
    prev = cur.replace(AS_OF, "TIMESTAMP '2024-01-24 00:00:00'")
    return f"""
WITH h AS (SELECT *, '2024-01-31' AS analysis_date FROM ({cur}) UNION ALL SELECT *, '2024-01-24' AS analysis_date FROM ({prev})),
l AS (SELECT station_id, max(analysis_date) AS analysis_date FROM h GROUP BY station_id)
SELECT h.* FROM h JOIN l ON l.station_id = h.station_id AND l.analysis_date = h.analysis_date
"""


SQL["api_latest_correlation"] = _corr_latest()


def _gate_sql(model: str, days: int, horizon: int, min_points: int, source: str | None = None) -> str:
    return (f"SELECT CAST(station_id AS BIGINT) AS station_id, '{model}' AS model_type, CAST({horizon} AS BIGINT) AS horizon_hours, "
            f"CAST(count(*) AS BIGINT) AS training_rows, 'success' AS status, CAST({horizon} AS BIGINT) AS n_points "
            f"FROM ({source or hourly_sql('aqi', days)}) GROUP BY station_id HAVING count(*) >= {min_points}")


SQL["forecast_run_gates"] = with_binding("g AS (" + _gate_sql("linear", 14, 24, 48) + " UNION ALL " + _gate_sql("arima", 7, 12, 48)
                                         + " UNION ALL " + _gate_sql("prophet", 14, 24, 20, raw_sql("aqi", 14)) + ")\nSELECT * FROM g")


SQL["grid_seed_upsert"] = with_binding(f"""{GRID.strip()},
sd AS {_sub('grid_provinces')}
SELECT CAST(p.grid_point_id AS BIGINT) AS grid_point_id, p.lat, p.lng, coalesce(sd.province_code, p.province_code) AS province_code,
       coalesce(sd.province_name, p.province_name) AS province_name, TRUE AS is_land, TRUE AS is_active
FROM pts p LEFT JOIN sd ON sd.grid_point_id = p.grid_point_id
""")


def _nudge_rounds(sql: str) -> str:
    """Twin of ``functions.numeric.round_half_up``: every ``round(x, d)`` becomes
    ``round(x + sign(x) * 1e-9, d)`` so exact decimal ties round away from zero."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, comma = 1, j + len(key), None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1 and comma is None:
                comma = k
            k += 1
        inner_end = comma if comma is not None else k - 1
        arg = _nudge_rounds(sql[j + len(key):inner_end])
        rest = sql[inner_end:k]
        out.append(sql[i:j] + f"round(({arg}) + sign({arg}) * 1e-9{rest}")
        i = k


SQL = {k: _nudge_rounds(v) for k, v in SQL.items()}
