"""Hand-computed golden rows for boundary cases (FIXTURES.md section 3)."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from envspark.plans.anomaly import detect_anomalies
from envspark.plans.grid import fuse, point_in_polygon, polygon_edges
from envspark.plans.health import health_impact
from envspark.plans.trend import trend_analysis
from envspark.plans.views import simple_forecast
from envspark.sources.polygons import read_geojson_polygons

AS_OF = datetime(2024, 1, 31)
AQ_SCHEMA = ("obs_id long, station_id int, observed_at timestamp_ntz, aqi int, pm25 double, pm10 double, o3 double, "
             "no2 double, so2 double, co double")


def _stations(spark, ids=(1,)):
    return spark.createDataFrame([(i, 10.0, 105.0, True) for i in ids], "station_id int, lat double, lng double, is_active boolean")


def _aq(spark, rows):
    full = [(i, s, t, a, p, None, None, None, None, None) for i, (s, t, a, p) in enumerate(rows)]
    return spark.createDataFrame(full, AQ_SCHEMA)


def test_anomaly_zero_spread_and_suppression(spark):
    t0 = AS_OF - timedelta(days=2)
    hist = [(1, t0 + timedelta(minutes=i), 50, 10.0) for i in range(12)]  # aqi constant -> std = 0, iqr = 0
    rec = [(1, AS_OF - timedelta(minutes=30), 90, 10.0)]
    aq = _aq(spark, hist + rec)
    got = detect_anomalies(aq, _stations(spark), AS_OF, scan_hours=2, metrics=["aqi"]).collect()
    # history includes the scanned row (T6): 12 x 50 and one 90 -> q1 = q3 = 50, iqr = 0 -> iqr_factor 0
    import numpy as np

    v = np.array([50.0] * 12 + [90.0])
    z = (90.0 - v.mean()) / v.std()
    assert len(got) == 1 and got[0]["method"] == "zscore" and got[0]["iqr_factor"] == 0.0
    assert got[0]["z_score"] == round(z, 3) and got[0]["severity"] == "warning"
    flat = _aq(spark, [(1, t0 + timedelta(minutes=i), 50, 10.0) for i in range(12)] + [(1, AS_OF - timedelta(minutes=30), 50, 10.0)])
    assert detect_anomalies(flat, _stations(spark), AS_OF, scan_hours=2, metrics=["aqi"]).count() == 0  # std = 0 -> z = 0
    obs = AS_OF - timedelta(minutes=30)
    for minutes, kept in [(59, False), (60, True), (61, True)]:
        prior = spark.createDataFrame([(1, "aqi", obs - timedelta(minutes=minutes))], "station_id int, metric string, detected_at timestamp_ntz")
        n = detect_anomalies(aq, _stations(spark), AS_OF, scan_hours=2, prior=prior, metrics=["aqi"]).count()
        assert (n == 1) == kept, minutes


def test_anomaly_needs_ten_history_rows(spark):
    t0 = AS_OF - timedelta(days=1)
    nine = [(1, t0 + timedelta(minutes=i), 50 + (i % 3), 10.0) for i in range(8)] + [(1, AS_OF - timedelta(minutes=5), 500, 10.0)]
    assert detect_anomalies(_aq(spark, nine), _stations(spark), AS_OF, scan_hours=2, metrics=["aqi"]).count() == 0
    ten = nine + [(1, t0, 51, 10.0)]
    assert detect_anomalies(_aq(spark, ten), _stations(spark), AS_OF, scan_hours=2, metrics=["aqi"]).count() == 1


def test_idw_boundaries(spark):
    # grid point at (10, 105); stations due north at 0.05, 29.99 and 30.0 km
    dlat = lambda km: km / 111.19492664455873
    grid = spark.createDataFrame([(1, AS_OF, 100, "openmeteo", 10.0, 105.0), (2, AS_OF, 41, "openmeteo", 12.0, 105.0)],
                                 "grid_point_id int, observed_at timestamp_ntz, aqi int, source_code string, lat double, lng double")
    st = spark.createDataFrame([(1, 200, 10.0 + dlat(0.05), 105.0), (2, 0, 10.0 + dlat(29.99), 105.0), (3, 0, 10.0 + dlat(30.0001), 105.0)],
                               "station_id int, aqi int, lat double, lng double")
    got = {r["grid_point_id"]: r for r in fuse(grid, st).collect()}
    w2 = 3 / 29.99 ** 2
    exp = round((100 + 200 * 100 + 0 * w2) / (1 + 100 + w2))
    assert got[1]["aqi"] == exp and got[1]["source_count"] == 3 and got[1]["source_code"] == "fused"
    assert got[1]["confidence_score"] == 1.0
    assert got[2]["aqi"] == 41 and got[2]["source_code"] == "openmeteo" and got[2]["source_count"] == 1
    assert got[2]["confidence_score"] == 0.33


def test_health_ties_and_gates(spark):
    t = AS_OF - timedelta(hours=1)
    rows = [(i, 1, t - timedelta(minutes=i), 600 if i == 0 else 40, 5.0, 5.0, None, None, None, None) for i in range(6)]
    rows += [(100 + i, 2, t - timedelta(minutes=i), 10, None, None, None, None, None, None) for i in range(6)]
    rows += [(200 + i, 3, t - timedelta(minutes=i), 10, None, None, None, None, None, None) for i in range(5)]
    aq = spark.createDataFrame(rows, AQ_SCHEMA)
    got = {r["station_id"]: r for r in health_impact(aq, _stations(spark, (1, 2, 3)), AS_OF).collect()}
    assert set(got) == {1, 2}  # station 3 has 5 rows
    assert got[1]["current_level"] == "hazardous" and got[1]["risk_level"] == "critical"
    assert got[1]["dominant_pollutant"] == "pm25"  # pm25 ties pm10 -> first wins
    assert got[1]["exposure_score"] == round(16 / (6 * 16) * 100, 1)
    assert got[1]["time_in_levels"] == {"good": 5}  # 600 is outside every band
    assert got[2]["dominant_pollutant"] == "pm25" and got[2]["pollutant_averages"] == {}


def test_trend_constant_series(spark):
    rows = [(1, AS_OF - timedelta(days=d, hours=1), 50, 0.0) for d in range(1, 8)]
    got = {r["metric"]: r for r in trend_analysis(_aq(spark, rows), _stations(spark), AS_OF).collect()}
    assert got["aqi"]["r_squared"] == 0.0 and got["aqi"]["direction"] == "stable" and got["aqi"]["slope"] == 0.0
    assert got["pm25"]["pct_change"] == 0.0  # start value 0 -> 0 %
    six = [(1, AS_OF - timedelta(days=d, hours=1), 50, 0.0) for d in range(1, 7)]
    assert trend_analysis(_aq(spark, six), _stations(spark), AS_OF).count() == 0


def test_simple_forecast_edges(spark):
    t = AS_OF - timedelta(hours=1)
    same = [(1, t, 50 + i, 1.0) for i in range(6)]  # identical timestamps -> slope 0
    down = [(2, t - timedelta(hours=i), 10 - 9 * (5 - i) if i < 5 else 100, 1.0) for i in range(6)]
    got = {r["station_id"]: r for r in simple_forecast(_aq(spark, same + down), AS_OF).collect()}
    assert got[1]["aqi_per_hour"] == 0.0
    assert got[2]["aqi_next_6h"] == 0  # negative projection clamps to 0


def test_geojson_polygons_hole_and_overlap(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]
    other = [[[3, 3], [6, 3], [6, 6], [3, 6], [3, 3]]]
    gj = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"shapeName": "Đà Nẵng"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [other]}},
    ]}
    path = tmp_path / "p.geojson"
    path.write_text(json.dumps(gj, ensure_ascii=False))
    polys, rings = read_geojson_polygons(spark, str(path))
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 3.5, 3.5), (4, 5.0, 5.0), (5, 9.0, 9.0)],
                                "grid_point_id int, lat double, lng double")
    got = {r["grid_point_id"]: r["province_name"] for r in point_in_polygon(pts, polys, polygon_edges(rings)).collect()}
    assert got == {1: "Đà Nẵng", 3: "Đà Nẵng", 4: "Unknown"}  # 2 in the hole, 3 in both (first wins), 5 outside


def test_payload_normalisation_golden(spark):
    from envspark.sources.payload import normalise_payloads

    docs = [
        (1, {"grid_point_id": 7, "fetched_at": "2024-01-05 06:10:00", "current": {"time": "2024-01-05T13:00", "us_aqi": 41.5,
             "pm2_5": 10.2, "pm10": "n/a", "ozone": float("nan"), "nitrogen_dioxide": 3, "sulphur_dioxide": None, "carbon_monoxide": 200}}),
        (2, {"grid_point_id": 8, "fetched_at": "2024-01-05 06:10:00", "current": {"time": "2024-01-05T13:00", "pm2_5": 5.0}}),
        (3, {"grid_point_id": 9, "fetched_at": "2024-01-05 06:10:00", "current": {"us_aqi": 10}}),
        (4, {"grid_point_id": 9, "fetched_at": "2024-01-05 06:10:00", "current": {"time": "2024-01-05T00:30", "us_aqi": 42.5}}),
    ]
    import json as _json

    df = spark.createDataFrame([(i, _json.dumps(d, allow_nan=True)) for i, d in docs], "payload_id long, json string")
    got = {r["payload_id"]: r for r in normalise_payloads(df).collect()}
    assert set(got) == {1, 3, 4}  # no us_aqi -> dropped
    assert got[3]["observed_at"] == datetime(2024, 1, 5, 6, 10)  # no time -> that of the fetch
    r = got[1]
    assert r["aqi"] == 42 and r["pm25"] == 10.2 and r["pm10"] is None and r["o3"] is None and r["so2"] is None
    assert r["no2"] == 3.0 and r["co"] == 200.0 and r["observed_at"] == datetime(2024, 1, 5, 6, 0)
    assert got[4]["aqi"] == 42 and got[4]["observed_at"] == datetime(2024, 1, 4, 17, 30)  # 42.5 -> 42 (half-even)


def test_upsert_golden(spark):
    from envspark.operators.merge import keyed_merge

    ex = spark.createDataFrame([(1, AS_OF, 10), (2, AS_OF, 20)], "grid_point_id int, observed_at timestamp_ntz, aqi int")
    new = spark.createDataFrame([(2, AS_OF, 21, 1), (2, AS_OF, 22, 2), (3, AS_OF, 30, 1)],
                                "grid_point_id int, observed_at timestamp_ntz, aqi int, _seq int")
    got = {r["grid_point_id"]: r["aqi"] for r in keyed_merge(ex, new, ["grid_point_id", "observed_at"]).collect()}
    assert got == {1: 10, 2: 22, 3: 30}  # existing kept, existing key updated (last in batch wins), new key inserted


def test_stateful_suppression_rule():
    from envspark.streaming.jobs import suppress_in_order

    h = 3600 * 1_000_000
    t = [0, 30 * 60 * 1_000_000, h, h + 1, 3 * h]
    keep, last = suppress_in_order(None, t, [1, 2, 3, 4, 5])
    # 0 kept; +30 min suppressed; exactly +60 min kept (emitted 0 is not > t - 1h); +60 min +1us suppressed; 3 h kept
    assert keep == [True, False, True, False, True] and last == 3 * h
    keep2, _ = suppress_in_order(last, [3 * h + 10], [6])  # state carries into the next micro-batch
    assert keep2 == [False]


def test_stateful_stream_matches_sequential_rule(spark):
    import __spark_entry__ as E
    from envspark.plans.anomaly import detect_anomalies
    from envspark.sources.binding import AS_OF as AS_OF_, Bound
    from envspark.streaming.jobs import suppress_in_order
    from tests.conftest import SF_MID

    got = {r["obs_id"] for r in E.queries()["stream_anomalies_stateful"](spark, SF_MID).collect()}
    b = Bound(spark, SF_MID)
    cand = detect_anomalies(b.aq, b.stations, AS_OF_, scan_hours=24).select(
        "station_id", "metric", "obs_id", F.unix_micros(F.col("detected_at").cast("timestamp")).alias("t")).collect()
    exp = set()
    for key in {(r["station_id"], r["metric"]) for r in cand}:
        rows = [r for r in cand if (r["station_id"], r["metric"]) == key]
        keep, _ = suppress_in_order(None, [r["t"] for r in rows], [r["obs_id"] for r in rows])
        exp |= {r["obs_id"] for r, k in zip(rows, keep) if k}
    assert got == exp
