"""Per-item autoregressions against a plain numpy refit at every cut-off."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from partcast.operators import linear as N
from tests.helpers import multi

LAGS = (1, 2, 7)


def refit(values, cut, end, scale_to, start=dt.date(2024, 1, 1), lags=LAGS):
    """Coefficients on all rows before ``cut`` and the forecasts of the days cut..end."""
    q = np.array(values, dtype=float)
    mu, sd = q[:scale_to].mean(), q[:scale_to].std() or 1.0
    y = list((q - mu) / sd)

    def row(history, t):
        day = (start + dt.timedelta(days=t)).weekday()
        return [1.0, *(history[t - k] for k in lags), math.sin(2 * math.pi * day / 7), math.cos(2 * math.pi * day / 7)]

    X = np.array([row(y, t) for t in range(max(lags), cut)])
    penalty = np.eye(X.shape[1])
    penalty[0, 0] = 0
    coef = np.linalg.solve(X.T @ X + penalty, X.T @ np.array(y[max(lags):cut]))
    history = y[:cut]
    for t in range(cut, end):
        history.append(float(np.dot(row(history, t), coef)))
    return coef, [max(v * sd + mu, 0.0) for v in history[cut:]]


def series(seed, n):
    rng = np.random.default_rng(seed)
    return [float(v) for v in np.where(rng.random(n) < 0.4, rng.integers(1, 9, n), 0)]


def test_every_fold_equals_a_refit(spark):
    data = {1: series(1, 60), 2: series(2, 83), 3: [2.0] * 50, 4: series(4, 9), 5: [0.0] * 40}
    got = {(r["item_id"], r["fold"]): r for r in
           N.autoregressions(multi(spark, data), F.floor(F.col("n") * 0.8), 7, LAGS).collect()}
    expected = {(i, f) for i, v in data.items() if int(len(v) * 0.8) > 7 for f in range(math.ceil((len(v) - int(len(v) * 0.8)) / 7))}
    assert set(got) == expected and not any(i == 4 for i, _ in got)
    for (item, fold), r in got.items():
        v = data[item]
        first = int(len(v) * 0.8)
        cut = first + 7 * fold
        coef, yhat = refit(v, cut, min(cut + 7, len(v)), first)
        assert r["coef"] == pytest.approx(coef, abs=1e-9)
        assert [d["yhat"] for d in r["days"]] == pytest.approx(yhat, abs=1e-9)
        assert [d["qty"] for d in r["days"]] == v[cut:cut + 7]


def test_backtest_statistics(spark):
    v = series(9, 100)
    row = N.backtest_refit(multi(spark, {7: v}), 7, 0.8, LAGS).first()
    maes, mapes = [], []
    for cut in range(80, 100, 7):
        yhat = refit(v, cut, min(cut + 7, 100), 80)[1]
        off = [abs(a - b) for a, b in zip(v[cut:], yhat)]
        maes.append(np.mean(off))
        mapes.append(np.mean([abs(a - round(b, 6)) / (a + 1e-8) for a, b in zip(v[cut:], yhat)]) * 100)
    assert row["n_folds"] == 3
    for name, x in (("mae", maes), ("mape", mapes)):
        for stat, f in (("mean", np.mean), ("min", np.min), ("max", np.max), ("std", lambda a: np.std(a, ddof=1))):
            assert row[f"{name}_{stat}"] == pytest.approx(f(x), rel=1e-6)


def test_single_series_is_a_model_per_item(spark):
    """A weekly pattern is learned per item, each with its own days; short ones are left out."""
    data = {i: [10.0 * i if d % 7 == i else 0.0 for d in range(140)] for i in range(1, 5)} | {9: [1.0] * 20}
    got = {r["item_id"]: r for r in N.single_series(multi(spark, data), 14).collect()}
    assert set(got) == {1, 2, 3, 4}
    for i, r in got.items():
        assert r["n_points"] == 14 and r["mae"] < 0.1 * 10 * i and len(r["coef"]) == len(N.feature_names())
        assert r["rmse"] >= r["mae"]


def test_jobs_do_not_grow_with_folds(spark):
    """One plan, whatever the number of cut-offs: the same exchanges for 2 folds as for 20."""
    dense = multi(spark, {1: series(1, 200)})
    plans = [N.backtest_refit(dense, steps, 0.8, LAGS)._jdf.queryExecution().executedPlan().toString().count("Exchange") for steps in (20, 2)]
    assert plans[0] == plans[1]


def test_days_without_demand_are_not_sent_on(spark):
    """Rows with demand, one row of an item without any; neither sums nor lists of days are made
    of the filled days."""
    data = {1: [0.0] * 50 + [3.0] + [0.0] * 49, 2: [0.0] * 60, 3: [1.0] * 40, 4: [1.0] * 9}
    rows = N.series(multi(spark, data), F.floor(F.col("n") * 0.8))
    assert {r["item_id"]: r["count"] for r in rows.groupBy("item_id").count().collect()} == {1: 1, 2: 1, 3: 40}
    plan = N.backtest_refit(multi(spark, data))._jdf.queryExecution().sparkPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_blocks_do_not_matter(spark, monkeypatch):
    data = {i: series(i, 40 + 7 * i) for i in range(8)}
    fits = lambda: {(r["item_id"], r["fold"]): r["coef"] for r in N.autoregressions(multi(spark, data), F.floor(F.col("n") * 0.8), 7, LAGS).collect()}
    whole = fits()
    monkeypatch.setattr(N, "ROWS", 30)
    small = fits()
    assert set(small) == set(whole) and all(small[k] == pytest.approx(whole[k], abs=1e-12) for k in whole)


def test_unknown_demand_counts_in_no_sum(spark):
    """Products with an unknown day are left out, and its own error is."""
    values = series(3, 60)
    start = dt.date(2024, 1, 1)
    rows = [(1, start + dt.timedelta(days=t), None if t in (20, 50) else v) for t, v in enumerate(values)]
    got = N.autoregressions(spark.createDataFrame(rows, "item_id long, ds date, qty double"), F.floor(F.col("n") * 0.8), 7, LAGS).orderBy("fold").first()
    q = np.array([np.nan if t in (20, 50) else v for t, v in enumerate(values)])
    y = (q - np.nanmean(q[:48])) / np.nanstd(q[:48])
    day = [(start + dt.timedelta(days=t)).weekday() * 2 * math.pi / 7 for t in range(60)]
    X = np.array([[1.0, *(y[t - k] for k in LAGS), math.sin(day[t]), math.cos(day[t])] for t in range(7, 48)])
    gram = np.nansum(X[:, :, None] * X[:, None, :], axis=0) + np.diag([0, 1, 1, 1, 1, 1])
    assert got["coef"] == pytest.approx(np.linalg.solve(gram, np.nansum(X * y[7:48, None], axis=0)), abs=1e-9)
    assert [d["qty"] for d in got["days"]] == [None if t == 50 else values[t] for t in range(48, 55)]


def test_a_gap_is_an_error(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=t), 1.0 + t % 3) for t in range(60) if t != 30]
    with pytest.raises(Exception, match="a day missing"):
        N.autoregressions(spark.createDataFrame(rows, "item_id long, ds date, qty double"), F.floor(F.col("n") * 0.8), 7, LAGS).collect()
