"""Likelihood ARIMA (J4) and the additive seasonal model on raw rows (J5) against dense computations."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from envspark.plans import arma
from envspark.plans import seasonal_model as S


def _arma(n, c, sd=2.0, seed=1):
    e, x = np.random.default_rng(seed).normal(0, sd, n + 50), np.zeros(n + 50)
    for t in range(2, n + 50):
        x[t] = c[0] * x[t - 1] + c[1] * x[t - 2] + e[t] + c[2] * e[t - 1] + c[3] * e[t - 2]
    return x[50:]


def _dense(p, x, ahead=0):
    """Log density of ``x`` and the expected next values, from the covariance matrix of the process."""
    psi = [1.0]
    for k in range(1, 900):
        moving = p[2] if k == 1 else p[3] if k == 2 else 0.0
        psi.append(moving + p[0] * psi[-1] + (p[1] * psi[-2] if k > 1 else 0.0))
    psi, n = np.array(psi), len(x)
    gamma = p[4] * np.array([psi[:900 - k] @ psi[k:] for k in range(n + ahead)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(n + ahead), np.arange(n + ahead)))]
    solved = np.linalg.solve(cov[:n, :n], x)
    return -0.5 * (np.linalg.slogdet(2 * np.pi * cov[:n, :n])[1] + x @ solved), cov[n:, :n] @ solved


def test_filter_gives_the_exact_likelihood_and_forecast():
    p, x = np.array([0.5, -0.3, 0.4, 0.2, 4.0]), _arma(60, (0.5, -0.3, 0.4, 0.2))
    want, ahead = _dense(p, x, 6)
    assert abs(arma.log_likelihoods(p[None], x).sum() - want) < 1e-6
    assert np.allclose(arma.forecast(p, x, 6), ahead, atol=1e-6)


def test_fit_is_a_maximum_and_finds_the_parameters():
    true = np.array([0.5, -0.3, 0.4, 0.2, 4.0])
    x = _arma(1200, true[:4])
    p, errors = arma.fit(x)
    top = arma.log_likelihoods(p[None], x).sum()
    nudges = np.concatenate([np.diag(np.full(5, s)) for s in (0.01, -0.01)])
    assert (arma.log_likelihoods(p + nudges, x).sum(1) <= top + 1e-6).all()
    assert (np.abs(p - true) < 4 * errors).all() and (errors > 0).all()


def test_fit_of_flat_and_short_series():
    p, errors = arma.fit(np.zeros(30))
    assert not p.any() and not errors.any() and (arma.forecast(p, np.zeros(30), 4) == 0).all()
    with pytest.raises(ValueError):
        arma.fit(np.ones(4))


# --- J5 ---------------------------------------------------------------------------------
AS_OF = datetime(2024, 1, 31)


def _raw(n=700, seed=3):
    """Unevenly spaced rows with ties in time, a bend in the trend and both waves."""
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 13 * 86400, n))
    at[10:14] = at[10]
    days = at / 86400
    y = 50 + 2 * days - 5 * np.clip(days - 7, 0, None) + 8 * np.sin(2 * np.pi * days) + 3 * np.cos(2 * np.pi * days / 7) + rng.normal(0, 1, n)
    return [AS_OF - timedelta(days=13, seconds=-int(s)) for s in at], y


def _frames(spark, groups):
    rows = [(s, i, t, float(v)) for s, (ts, y) in groups.items() for i, (t, v) in enumerate(zip(ts, y))]
    aq = spark.createDataFrame(rows, "station_id int, obs_id long, observed_at timestamp_ntz, aqi double").repartition(5)
    return aq, spark.createDataFrame([(s, True) for s in groups], "station_id int, is_active boolean")


def _design(epoch, y):
    """Columns of the model from the rows themselves; changepoints by row number."""
    history = int(np.floor(len(y) * 0.8))
    number = min(25, history - 1)
    begin, span = epoch[0], epoch[-1] - epoch[0]
    t = (epoch - begin) / span
    bends = t[np.linspace(0, history - 1, number + 1).round().astype(int)[1:]]
    return np.concatenate([np.ones((len(t), 1)), t[:, None], np.maximum(t[:, None] - bends, 0), S.waves(epoch)], 1), y / np.abs(y).max()


def _density(x, y, b, s):
    weight = np.abs(b[2:-14]).sum() / 0.05
    return (len(y) * np.log(s) + ((y - x @ b) ** 2).sum() / (2 * s * s) + s * s / (2 * 0.25) + (b[:2] ** 2).sum() / 50 + weight
            + (b[-14:] ** 2).sum() / 200)


def test_segment_sums_are_the_products_of_the_columns():
    ts, y = _raw()
    epoch = np.array([(t - datetime(1970, 1, 1)).total_seconds() for t in ts])
    x, scaled = _design(epoch, y)
    gram = S.gram_of_series(epoch, y)
    assert np.allclose(gram.products, x.T @ x, atol=1e-7) and np.allclose(gram.target, x.T @ scaled, atol=1e-7)
    assert gram.rows == len(y) and abs(gram.square - scaled @ scaled) < 1e-7


def test_solution_is_the_most_probable_one():
    ts, y = _raw()
    epoch = np.array([(t - datetime(1970, 1, 1)).total_seconds() for t in ts])
    x, scaled = _design(epoch, y)
    b, noise = S.gram_of_series(epoch, y).solve()
    best, rng = _density(x, scaled, b, noise), np.random.default_rng(1)
    for size in (1e-1, 1e-2, 1e-3, 1e-4):
        for _ in range(60):
            assert _density(x, scaled, b + rng.normal(0, size, len(b)), noise) >= best - 1e-9
            assert _density(x, scaled, b + size * np.eye(len(b))[rng.integers(len(b))], noise) >= best - 1e-9
        assert _density(x, scaled, b, noise * (1 + size)) >= best and _density(x, scaled, b, noise * (1 - size)) >= best
    used = np.flatnonzero(b[2:-14])
    assert 0 < len(used) < 25  # a Laplace prior leaves changepoints out
    slope = (x.T @ (scaled - x @ b) / noise**2)[2:-14]
    assert np.abs(np.abs(slope[used]) - 20).max() < 1e-3 and np.abs(slope).max() < 20 + 1e-3


def test_seasonal_points_on_raw_rows(spark):
    groups = {1: _raw(), 2: _raw(60, 5), 3: _raw(19, 6), 4: ([AS_OF - timedelta(days=1)] * 30, np.arange(30.0)), 5: _raw(20, 7)}
    aq, stations = _frames(spark, groups)
    got = {}
    for r in S.seasonal_points(aq, stations, AS_OF).collect():
        got.setdefault(r["station_id"], []).append(r)
    assert set(got) == {1, 2, 4, 5}  # 19 raw rows are too few
    assert len(got[4]) == 1 and got[4][0]["status"] == "failed" and got[4][0]["step"] is None
    assert got[5][0]["mae"] is None and got[1][0]["mae"] is not None  # 4 rows held out are too few
    for s in (1, 2, 5):
        ts, y = groups[s]
        epoch = np.array([(t - datetime(1970, 1, 1)).total_seconds() for t in ts])
        series = S.SeasonalSeries(epoch, y)
        values, half = series.forecast(24)
        rows = sorted(got[s], key=lambda r: r["step"])
        assert [r["training_rows"] for r in rows] == [len(y)] * 24 and [r["step"] for r in rows] == list(range(1, 25))
        assert np.allclose([r["predicted_value"] for r in rows], values, atol=0.011)
        assert np.allclose([r["upper_bound"] for r in rows], values + half, atol=0.011)
        assert [r["predicted_at"] for r in rows] == [ts[-1] + timedelta(hours=k) for k in range(1, 25)]
        split = int(len(y) * 0.8)
        if len(y) - split >= 5:
            e = y[split:] - series.holdout(split)
            assert abs(rows[0]["mae"] - np.abs(e).mean()) < 2e-3 and abs(rows[0]["rmse"] - np.sqrt((e**2).mean())) < 2e-3


def test_segments_follow_row_numbers(spark):
    for n in (20, 31, 32, 33, 100, 1234):
        history = int(np.floor(n * 0.8))
        number = min(25, history - 1)
        at = np.linspace(0, history - 1, number + 1).round()[1:]
        got = spark.range(n).select(S._segment(F.col("id"), F.lit(n).cast("long")).alias("s"), "id").orderBy("id").collect()
        assert [r["s"] for r in got] == [int((at <= k).sum()) for k in range(n)]


def test_seasonal_plan_groups_no_raw_rows(spark):
    """Rows meet Python in their own partitions; grouped Python sees sums only."""
    aq, stations = _frames(spark, {1: _raw(100)})
    sums = S.segment_sums(S.training_rows(aq, stations, AS_OF, "aqi"), 0.0, 1.0)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    assert sums.count() <= 2 * 26 * len(S.UPPER[0])
