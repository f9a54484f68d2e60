"""Golden rows for the scalar column functions (FIXTURES.md section 3)."""

import math

from pyspark.sql import functions as F

from envspark.functions import aqi_category, aqi_level, confidence_from_mae, exposure_weight, haversine_km, idw_weight, pm25_to_aqi
from envspark.functions.numeric import mean_half_even, ratio_half_even
from envspark.functions.text import slugify_vi


def _col(spark, values, fn, dtype="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_aqi_category(spark):
    vals = [None, 0.0, 50.0, 50.5, 51.0, 100.0, 150.0, 200.0, 300.0, 301.0, 500.0, 501.0]
    assert _col(spark, vals, aqi_category) == [
        "unknown", "good", "good", "moderate", "moderate", "moderate", "unhealthy_sensitive", "unhealthy",
        "very_unhealthy", "hazardous", "hazardous", "hazardous"]


def test_aqi_level_strict_gap_is_hazardous(spark):
    vals = [0.0, 50.0, 50.5, 51.0, 100.0, 301.0, 500.0, 600.0]
    assert _col(spark, vals, lambda c: aqi_level(c, strict=True)) == [
        "good", "good", "hazardous", "moderate", "moderate", "hazardous", "hazardous", "hazardous"]
    assert _col(spark, vals, aqi_level)[2] == "moderate"


def test_exposure_weight(spark):
    assert _col(spark, [0.0, 50.0, 51.0, 150.0, 200.0, 300.0, 500.0, 600.0], exposure_weight) == [0, 0, 1, 2, 4, 8, 16, 16]


def test_pm25_to_aqi(spark):
    vals = [-1.0, float("nan"), 0.0, 12.0, 12.05, 12.1, 35.4, 55.5, 150.4, 250.5, 500.4, 600.0]
    strict = _col(spark, vals, lambda c: pm25_to_aqi(c, strict=True))
    assert strict == [None, None, 0, 50, None, 51, 100, 151, 200, 301, 500, 500]
    default = _col(spark, vals, pm25_to_aqi)
    assert default[4] == 50  # 12.05 truncates to 12.0


def test_haversine_and_idw(spark):
    df = spark.createDataFrame([(10.0, 105.0, 10.0, 105.0), (10.0, 105.0, 10.2, 105.0)], "a double, b double, c double, d double")
    d = [r[0] for r in df.select(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert d[0] == 0.0
    assert abs(d[1] - 2 * 6371 * math.asin(math.sin(math.radians(0.1)))) < 1e-9
    w = _col(spark, [0.05, 0.1, 29.99, 30.0], idw_weight)
    assert w[0] == 100.0 and abs(w[1] - 300.0) < 1e-9 and abs(w[2] - 3 / 29.99 ** 2) < 1e-12


def test_confidence_from_mae(spark):
    assert _col(spark, [None, 0.0, 5.0, 50.0, 70.0, 90.0], confidence_from_mae) == [0.5, 0.95, 0.95, 0.5, 0.3, 0.3]


def test_half_even_exact(spark):
    df = spark.createDataFrame([(1, 8), (3, 8), (5, 8), (7, 8), (1, 2), (3, 2), (-1, 2)], "n long, d long")
    got = [r[0] for r in df.select(ratio_half_even(F.col("n"), F.col("d"))).collect()]
    assert got == [0, 0, 1, 1, 0, 2, 0]
    m = spark.createDataFrame([(1.0,), (1.25,)], "x double").agg(mean_half_even(F.col("x"), 1, scale_in=2)).first()[0]
    assert m == 1.1  # 1.125 -> 1.1 (half-even at the tie), but exact


def test_slugify(spark):
    df = spark.createDataFrame([("Khánh Hòa",), ("Đà Nẵng",), ("Hà Nội",)], "s string")
    assert [r[0] for r in df.select(slugify_vi(F.col("s"))).collect()] == ["khanhhoa", "danang", "hanoi"]
