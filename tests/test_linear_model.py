"""Linear forecast from sums of products: against the one-series fit, on collinear and short series."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from envspark.plans import linear_model as L
from envspark.plans.forecast import forecast_features, linear_fit_predict

START = datetime(2024, 1, 1)


def _hourly(spark, series):
    rows = [(s, START + timedelta(hours=int(h)), float(v)) for s, (hours, y) in series.items() for h, v in zip(hours, y)]
    return spark.createDataFrame(rows, "station_id int, ts timestamp_ntz, y double").repartition(3)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    noisy = {s: (np.sort(rng.choice(336, n, replace=False)), level + 15 * np.sin(np.arange(n) / 4) + rng.normal(0, 3, n))
             for s, n, level in [(1, 48, 60), (2, 200, 5000), (3, 336, 10)]}
    return noisy | {4: (np.arange(47), np.arange(47.0)), 5: (np.arange(60), np.full(60, 7.0)), 6: (np.arange(49), np.zeros(49))}


def test_points_equal_the_fit_of_one_series(spark, series):
    got = L.linear_points(forecast_features(_hourly(spark, series)), "aqi").toPandas()
    assert set(got.station_id) == {1, 2, 3, 5, 6}  # 47 hours are below the gate
    assert set(got.status) == {"success"} and got.error_message.isna().all()
    for station in (1, 2, 3):
        hours, y = series[station]
        ts = pd.DatetimeIndex(START + pd.to_timedelta(hours, unit="h"))
        (mae, rmse, mape), points = linear_fit_predict(ts, y, 24)
        mine = got[got.station_id == station].sort_values("step")
        assert (mine.training_rows == len(y)).all()
        assert np.allclose(mine[["mae", "rmse", "mape"]].iloc[0], (mae, rmse, mape), atol=2e-3)
        assert np.allclose(mine[["predicted_value", "lower_bound", "upper_bound"]], [p[2:] for p in points], atol=2e-2)
        assert mine.predicted_at.tolist() == [p[1] for p in points]


def test_constant_series_stay_constant(spark, series):
    got = L.linear_points(forecast_features(_hourly(spark, {s: series[s] for s in (5, 6)})), "aqi").toPandas()
    assert np.allclose(got[got.station_id == 5].predicted_value, 7.0) and (got[got.station_id == 6].predicted_value == 0).all()
    assert (got.mae == 0).all() and got[got.station_id == 6].mape.isna().all()
    assert np.allclose(got.upper_bound, got.predicted_value) and np.allclose(got.lower_bound, got.predicted_value)


def test_coefficients_solve_the_normal_equations(spark, series):
    hourly = _hourly(spark, {2: series[2]})
    rows = forecast_features(hourly).toPandas().sort_values("ts")
    model = L.linear_model(forecast_features(hourly)).toPandas().iloc[0]
    design = np.column_stack([np.ones(len(rows)), rows[L.FEATURES].to_numpy(float)])
    beta = model[["intercept", *L.FEATURES]].to_numpy(float)
    assert np.allclose(design @ beta, design @ np.linalg.lstsq(design, rows.y, rcond=None)[0], atol=1e-5)
    assert np.isclose(model.spread, np.std(rows.y - design @ beta))


def test_a_failing_station_does_not_stop_the_others(spark, series):
    rows = L.numbered_features(forecast_features(_hourly(spark, {1: series[1], 2: series[2]})))
    broken = rows.selectExpr("*", "IF(station_id = 1, double('NaN'), lag_1h) AS odd").drop("lag_1h").withColumnRenamed("odd", "lag_1h")
    model = L.fit(broken).toPandas().set_index("station_id")
    assert model.error_message[1] and model.coefficients[1] is None
    assert model.error_message[2] is None and len(model.coefficients[2]) == 12


def test_no_series(spark):
    assert L.linear_points(forecast_features(_hourly(spark, {1: ([], [])})), "aqi").count() == 0


def test_numpy_sees_sums_only(spark, series):
    plan = L.fit(L.numbered_features(forecast_features(_hourly(spark, {1: series[1]}))))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan
    assert plan.index("FlatMapGroupsInPandas") < plan.index("Aggregate")  # the aggregate lies below, nearer the rows
