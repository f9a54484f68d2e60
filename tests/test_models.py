"""Forecast / ML invariants (no SQL oracle): horizons, bounds, recoveries."""

import numpy as np
import pytest
from pyspark.sql import functions as F
import pandas as pd

from envspark.plans.forecast import _hours, _LinearSeries, arima_fit_predict, linear_fit_predict, seasonal_fit_predict
from tests.conftest import SF_MID


def _series(n=200, seed=0):
    rng = np.random.default_rng(seed)
    ts = pd.date_range("2024-01-01", periods=n, freq="h")
    y = 60 + 15 * np.sin(2 * np.pi * np.arange(n) / 24) + 0.05 * np.arange(n) + rng.normal(0, 1, n)
    return ts, y


def test_linear_features_match_pandas():
    ts, y = _series(60)
    s = pd.Series(y)
    want = np.column_stack([
        np.ones(60), ts.hour, ts.dayofweek, np.sin(2 * np.pi * ts.hour / 24), np.cos(2 * np.pi * ts.hour / 24),
        np.sin(2 * np.pi * ts.dayofweek / 7), np.cos(2 * np.pi * ts.dayofweek / 7), s.rolling(6, 1).mean(), s.rolling(6, 1).std().fillna(0),
        s.rolling(24, 1).mean(), s.shift(1).bfill(), s.shift(24).bfill()])
    series = _LinearSeries(_hours(ts), y)
    assert np.allclose(series.rows, want)
    # normal equations, solved independently
    beta = np.linalg.pinv(want) @ y
    assert np.allclose(want @ series.solve(60), want @ beta)


def test_linear_horizon_and_bounds():
    ts, y = _series()
    (mae, rmse, mape), rows = linear_fit_predict(ts, y, 24)
    assert len(rows) == 24 and mae is not None and rmse >= mae
    for _, _, v, lo, hi in rows:
        assert v >= 0 and lo <= v <= hi


def test_seasonal_recovers_daily_cycle():
    ts, y = _series(336)
    (mae, _, _), rows = seasonal_fit_predict(ts, y, 24)
    truth = 60 + 15 * np.sin(2 * np.pi * np.arange(336, 360) / 24) + 0.05 * np.arange(336, 360)
    pred = np.array([r[2] for r in rows])
    assert np.mean(np.abs(pred - truth)) < 3.0 and mae < 3.0


def test_arima_horizon():
    ts, y = _series(120, seed=5)
    _, rows = arima_fit_predict(ts, y, 12)
    assert len(rows) == 12
    for _, _, v, lo, hi in rows:
        assert lo <= hi and (lo <= v or lo == 0.0)


def test_forecast_queries_shapes(spark):
    import __spark_entry__ as E

    q = E.queries()
    runs = q["forecast_runs"](spark, SF_MID).collect()
    assert {r["model_type"] for r in runs} == {"linear", "arima", "prophet"}
    for r in runs:
        assert r["status"] in ("success", "failed")
        if r["status"] == "success":
            assert r["n_points"] == r["horizon_hours"]


def test_promotion_rule(spark):
    from envspark.plans.grid_ml import promote

    ch = spark.createDataFrame([(9.6,)], "mae double")
    champ = spark.createDataFrame([(10.0,)], "mae double")
    assert promote(ch, None).first()["promoted"] is True
    assert promote(ch, champ).first()["promoted"] is False  # 9.6 > 10 x 0.95
    assert promote(spark.createDataFrame([(9.5,)], "mae double"), champ).first()["promoted"] is True


def test_station_folds_do_not_leak(spark):
    from envspark.plans.grid_ml import station_folds

    rows = [(s, float(i)) for s in range(7) for i in range(10 + s)]
    df = spark.createDataFrame(rows, "station_id int, aqi double")
    withf, folds = station_folds(df)
    per_station = withf.groupBy("station_id").agg(F.countDistinct("fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in per_station)
    assert {r["fold"] for r in folds.collect()} == set(range(5)) and folds.first()["k"] == 5


def test_training_saves_champion(spark, tmp_path):
    from envspark.plans.grid_ml import run_grid_training
    from envspark.sources.binding import AS_OF, Bound

    b = Bound(spark, SF_MID)
    params = {"maxIter": 2, "stepSize": 0.06, "maxDepth": 3, "minInstancesPerNode": 15, "seed": 42, "maxBins": 32}
    model, meta = run_grid_training(b.aq, b.wx, b.stations, AS_OF, params=params, model_dir=str(tmp_path))
    row = meta.first()
    assert row["promoted"] is True and row["folds"] == 5 and row["mae"] > 0
    assert (tmp_path / "champion").exists() and (tmp_path / "champion_meta").exists()


def test_registered_training_is_the_reference_model(spark, monkeypatch):
    from envspark import catalog
    from envspark.config import GBT_PARAMS
    from envspark.plans import grid_ml

    class Stop(Exception):
        pass

    seen = []

    def spy(*args, params=None, **kwargs):
        seen.append(params)
        raise Stop

    monkeypatch.setattr(grid_ml, "run_grid_training", spy)
    for name in ("grid_ml_cv", "grid_ml_predict"):
        with pytest.raises(Stop):
            catalog.QUERIES[name](spark, SF_MID)
    assert seen == [GBT_PARAMS, GBT_PARAMS] and GBT_PARAMS["maxIter"] == 300


def test_prediction_uses_the_stored_champion(spark, monkeypatch):
    from envspark import catalog
    from envspark.plans import grid_ml

    held = []
    load = grid_ml.load_champion
    monkeypatch.setattr(grid_ml, "load_champion", lambda *a: held.append((load(*a), spark.read.parquet(f"{a[1]}/champion_meta").first())) or held[0][0])
    monkeypatch.setattr(catalog, "GBT_PARAMS", {**catalog.GBT_PARAMS, "maxIter": 1, "maxDepth": 2})
    got = {r["confidence_score"] for r in catalog.QUERIES["grid_ml_predict"](spark, SF_MID).collect()}
    (_, mae), meta = held[0]
    assert mae == meta["mae"] and meta["cv_kind"].startswith("group_kfold")
    assert got == {round(min(0.95, max(0.3, 1 - mae / 100)), 2)}


def test_forecasts_are_deterministic(spark):
    import __spark_entry__ as E

    q = E.queries()["forecast_linear"]
    a = sorted(map(tuple, q(spark, SF_MID).collect()))
    b = sorted(map(tuple, q(spark, SF_MID).collect()))
    assert a == b and len(a) > 0


def test_lightest_folds_equal_one_by_one():
    import random

    from envspark.plans.grid_ml import lightest_folds

    rnd = random.Random(3)
    for _ in range(300):
        k = rnd.randint(1, 6)
        held = {rnd.randint(1, 40): rnd.randint(1, 12) for _ in range(rnd.randint(1, 7))}
        plan = lightest_folds(list(held.items()), k)
        load = [0] * k
        for size in sorted(held, reverse=True):
            begin, turn = plan[size]
            for r in range(held[size]):
                f = load.index(min(load))
                assert f == (begin[r] if r < len(begin) else turn[(r - len(begin)) % k])
                load[f] += size


def _training_rows(spark, n=1500):
    import random

    rnd = random.Random(4)
    rows = []
    for i in range(n):
        x = [rnd.choice([None, rnd.uniform(-2, 2), float(rnd.randint(0, 5))]) for _ in range(3)]
        y = 10 * (x[0] or 3.0) + (5 * x[1] if x[1] is not None else -20) + rnd.random()
        rows.append((i % 30, i, *x, y, i % 30 % 5))
    return spark.createDataFrame(rows, "station_id int, ts int, a double, b double, c double, aqi double, fold int")


def test_boosting_over_blocks_equals_one_block(spark, monkeypatch):
    from envspark.operators import boosting as B

    df, s = _training_rows(spark), B.Settings(5, 0.1, 4, 15)
    monkeypatch.setattr(B, "REPLAY", 2)
    one, e1, n1 = B.fit(df, ["station_id", "ts"], ["a", "b", "c"], "aqi", "fold", 5, s)
    monkeypatch.setattr(B, "ROWS_PER_BLOCK", 200)
    many, e8, n8 = B.fit(df.repartition(3), ["station_id", "ts"], ["a", "b", "c"], "aqi", "fold", 5, s)
    assert n1 == n8 == 1500 and e1.keys() == e8.keys()
    assert all(abs(p - q) < 1e-6 * max(1, p) for m in e1 for p, q in zip(e1[m], e8[m]))
    for a, b in zip(one.trees, many.trees):
        assert (a.feature == b.feature).all() and (a.code == b.code).all() and abs(a.value - b.value).max() < 1e-9


def test_boosting_learns_missing_values_and_survives_storage(spark, tmp_path):
    import numpy as np

    from envspark.operators import boosting as B

    df, s = _training_rows(spark), B.Settings(80, 0.1, 6, 15)
    model, errors, _ = B.fit(df, ["station_id", "ts"], ["a", "b", "c"], "aqi", "fold", 5, s)
    spread = df.agg(F.stddev("aqi")).first()[0]
    rmse = [(q / n) ** 0.5 for m, (n, _, q) in errors.items() if m >= 0]
    assert max(rmse) < 0.25 * spread  # a third of each feature is missing, and missing values carry the answer
    assert sum(n for m, (n, _, _) in errors.items() if m >= 0) == 1500
    assert all((t.feature >= 0).sum() <= s.leaves - 1 for t in model.trees)
    model.save(spark, str(tmp_path / "m"))
    loaded = B.Boosted.load(spark, str(tmp_path / "m"))
    p = np.array([r["prediction"] for r in model.transform(df).orderBy("ts").select("prediction").collect()])
    q = np.array([r["prediction"] for r in loaded.transform(df).orderBy("ts").select("prediction").collect()])
    y = np.array([r["aqi"] for r in df.orderBy("ts").select("aqi").collect()])
    assert (p == q).all() and abs(((p - y) ** 2).sum() - errors[-1][2]) < 1e-6 * errors[-1][2] + 1e-6


def test_split_search_matches_brute_force():
    import numpy as np

    from envspark.operators import boosting as B

    rng = np.random.default_rng(2)
    codes, g = rng.integers(0, 6, (90, 2)).astype(np.uint8), rng.standard_normal(90)
    codes[rng.random((90, 2)) < 0.2] = B.MISSING
    total, n, gain, feature, code, left, gl, nl = B.best_split(B.histogram(codes.T, g, np.zeros(90, np.int64), 1)[0], 15)
    best = 0
    for f in range(2):
        for c in range(6):
            for to_left in (False, True):
                side = np.where(codes[:, f] == B.MISSING, to_left, codes[:, f] <= c)
                if 15 <= side.sum() <= 75:
                    best = max(best, g[side].sum() ** 2 / side.sum() + g[~side].sum() ** 2 / (~side).sum() - g.sum() ** 2 / 90)
    assert abs(gain - best) < 1e-9 and n == 90
    side = np.where(codes[:, feature] == B.MISSING, left, codes[:, feature] <= code)
    assert side.sum() == nl and abs(g[side].sum() - gl) < 1e-9


def test_second_run_keeps_the_champion(spark, tmp_path):
    from envspark.plans import grid_ml
    from envspark.sources.binding import AS_OF, Bound

    b = Bound(spark, SF_MID)
    params = {"maxIter": 2, "stepSize": 0.06, "maxDepth": 3, "minInstancesPerNode": 15, "seed": 42, "maxBins": 32}
    grid_ml.run_grid_training(b.aq, b.wx, b.stations, AS_OF, params=params, model_dir=str(tmp_path))
    stored = grid_ml.champion_meta(spark, str(tmp_path))
    before = stored.first()
    _, meta = grid_ml.run_grid_training(b.aq, b.wx, b.stations, AS_OF, params=params, model_dir=str(tmp_path), champion=stored)
    row = meta.first()
    assert row["promoted"] is False and row["champion_mae_before"] == before["mae"] == row["mae"]
    assert grid_ml.champion_meta(spark, str(tmp_path)).first() == before
    with pytest.raises(ValueError, match="insufficient"):
        grid_ml.run_grid_training(b.aq.limit(3), b.wx, b.stations, AS_OF, params=params)
