"""Closed-form forecasters against step-by-step recurrences (our own brute
force, written from the published methods), plus edge series."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partcast.operators import baselines as B
from partcast.params import Params
from tests.helpers import multi, series

P = Params()


def ses_fold(x, a=0.3):
    s = x[0]
    for i in range(1, len(x)):
        s = a * x[i - 1] + (1 - a) * s
    return s


def croston_fold(x, a=0.1):
    idx = [i for i, v in enumerate(x) if v > 0]
    if not idx:
        return 0.0
    z, p = x[idx[0]], idx[0] + 1
    for j in range(1, len(idx)):
        z = a * x[idx[j]] + (1 - a) * z
        p = a * (idx[j] - idx[j - 1]) + (1 - a) * p
    return z / p if p > 0 else 0.0


def tsb_fold(x, a=0.1):
    idx = [i for i, v in enumerate(x) if v > 0]
    prob, size = 0.1, 0.0
    if idx:
        size, prob = x[idx[0]], 1 / (idx[0] + 1)
    for v in x:
        if v > 0:
            size = a * v + (1 - a) * size
            prob = a + (1 - a) * prob
        else:
            prob = (1 - a) * prob
    return max(prob * size, 0.0)


def ma_nonzero_fold(x, w=3):
    nz = [v for v in x if v > 0]
    if not nz:
        return 0.0
    avg = np.mean(nz[-w:])
    return avg * len(nz) / len(x)


def consts(spark, mapping):
    c = B.forecast_constants(multi(spark, mapping), P.ses_alpha, P.croston_alpha)
    return {r["item_id"]: r for r in c.collect()}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 0, 0, 1, 2, 5, 7.5]), min_size=8, max_size=60), min_size=1, max_size=6))
def test_closed_forms_match_recurrences(spark, data):
    mapping = {i + 1: x for i, x in enumerate(data)}
    got = consts(spark, mapping)
    for item, x in mapping.items():
        r = got[item]
        assert r["ExpSmooth"] == pytest.approx(ses_fold(x), abs=1e-9)
        assert r["Croston"] == pytest.approx(croston_fold(x), abs=1e-9)
        assert r["SBA"] == pytest.approx(croston_fold(x) * 0.95, abs=1e-9)
        assert r["TSB"] == pytest.approx(tsb_fold(x), abs=1e-9)
        assert r["MA_NonZero"] == pytest.approx(ma_nonzero_fold(x), abs=1e-9)
        assert r["MA_7"] == pytest.approx(np.mean(x[-7:]))
        assert r["Naive"] == x[-1]
        assert r["WMA_7"] == pytest.approx(sum(w * v for w, v in zip(range(1, 8), x[-7:])) / 28)


def test_edge_series(spark):
    got = consts(spark, {1: [0, 0, 0, 7, 0], 2: [0] * 30, 3: [4, 0, 0, 2], 4: [1, 2, 3, 4, 5]})
    assert got[1]["Croston"] == pytest.approx(7 / 4)            # single: z = 7, p = 4
    assert got[2]["Croston"] == 0 and got[2]["TSB"] == 0 and got[2]["MA_NonZero"] == 0
    assert got[3]["Croston"] == pytest.approx(croston_fold([4, 0, 0, 2]))   # first-day demand: p starts at 1
    assert got[3]["TSB"] == pytest.approx(tsb_fold([4, 0, 0, 2]))
    assert got[4]["WMA_7"] is None                               # fewer than 7 rows


def test_seasonal_quirk(spark):
    x = list(range(1, 31))
    fc = B.to_long(B.forecast_constants(series(spark, x), 0.3, 0.1), ("Seasonal_7",), 14)
    vals = [r["yhat"] for r in fc.orderBy("h").collect()]
    assert vals[:7] == [24, 25, 26, 27, 28, 29, 30]
    assert vals[7:] == [30] * 7        # h >= 8 repeats the last value


def test_importances_of_saved_models(spark, tmp_path):
    """Read from the saved nodes, they are the model's own, under the assembler's names."""
    import datetime as dt

    from pyspark.sql import functions as F

    from partcast.operators import ml as M

    p = Params().with_(gbt_trees=3, gbt_depth=2, n_lags=3)
    rows = [(i % 3, dt.date(2024, 1, 1) + dt.timedelta(days=d), float((d * (i + 1)) % 5))
            for i in range(3) for d in range(40)]
    dense = spark.createDataFrame(rows, "item_id long, ds date, qty double")
    sup = M.supervised(dense, p.n_lags, 5)
    model = M.fit_global_gbt(sup.where(F.col("split") == "train"), p)
    path = M.save_model(model, f"file://{tmp_path}/model")
    imp = M.importances(spark, [("g", f"{path}/stages/*GBT*", M.feature_names(p.n_lags))])
    got = {r["feature"]: r for r in imp.collect()}
    assert set(got) == set(M.feature_names(p.n_lags)) and imp.count() == len(got)
    assert {r["kind"] for f, r in got.items() if f.startswith("lag_")} == {"lag"}
    own = dict(zip(model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()))
    assert all(got[f]["importance"] == pytest.approx(v, abs=1e-12) for f, v in own.items())
    top = M.importance_summary(imp).collect()
    assert len(top) <= 20 and top[0]["lag_share"] + top[0]["exog_share"] == pytest.approx(1.0)


def test_backtest_ml_small(spark):
    import datetime as dt

    from partcast.operators.backtest import backtest_ml

    p = Params().with_(gbt_trees=2, gbt_depth=2, n_lags=3)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=d), float((d * (i + 2)) % 4))
            for i in range(3) for d in range(30)]
    dense = spark.createDataFrame(rows, "item_id long, ds date, qty double")
    # cut-offs at 24 and 27 of 30 days
    res = {r["item_id"]: r for r in backtest_ml(dense, p, steps=3).collect()}
    assert set(res) == {0, 1, 2}
    assert all(r["n_folds"] == 2 and r["mae_mean"] >= 0 for r in res.values())


def test_recursion_in_one_pass_is_the_recursion_day_by_day(spark):
    """Each day scored by Spark's own model from the lags of the days before."""
    import datetime as dt

    from pyspark.sql import functions as F

    from partcast.operators import ml as M

    p = Params().with_(gbt_trees=4, gbt_depth=3, n_lags=3)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=d), float((d * (i + 2)) % 5)) for i in range(4) for d in range(40)]
    sup = M.supervised(spark.createDataFrame(rows, "item_id long, ds date, qty double"), p.n_lags, 6).cache()
    model = M.fit_global_gbt(sup.where(F.col("split") == "train"), p)
    got = {(r["item_id"], r["h"]): (r["ds"], r["yhat"]) for r in M.recursive_forecast(model, sup, p, F.col("split") == "train", 6).collect()}
    past = {i: [r["y"] for r in sup.where(f"item_id = {i} AND split = 'train'").orderBy("ds").collect()] for i in range(4)}
    last = sup.where("split = 'train'").groupBy("item_id").agg(F.max_by(F.struct("mu", "sd", "item_code", "ds"), "ds").alias("r")).select("item_id", "r.*").collect()
    for h in range(1, 7):
        state = [(r["item_id"], r["mu"], r["sd"], r["item_code"], r["ds"] + dt.timedelta(days=h), *past[r["item_id"]][-1:-4:-1]) for r in last]
        df = spark.createDataFrame(state, "item_id long, mu double, sd double, item_code double, ds date, lag_1 double, lag_2 double, lag_3 double")
        for r in model.transform(df.withColumns(M.calendar_cols(F.col("ds")))).collect():
            past[r["item_id"]].append(r[M.FITTED])
            assert got[r["item_id"], h] == (r["ds"], pytest.approx(max(r[M.FITTED] * r["sd"] + r["mu"], 0.0), abs=1e-9))
    assert len(got) == 24
