"""Train-all semantics on a tiny fixture: statuses, routes and failures as rows."""

import datetime as dt

from partcast.operators import ml as M
from partcast.params import Params


def _series(item, values):
    return [(item, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]


def _daily():
    rows = (_series(1, [3] * 5)                                      # 5 observed days
            + _series(5, [2] * 12)                                   # 12 observed, 12 from first to last
            + _series(2, [(i % 3) + 1 for i in range(60)])           # no zero days: Tweedie 1.3
            + _series(3, [4 if i % 3 == 0 else 0 for i in range(60)])  # 66% zeros: Tweedie 1.7
            + _series(4, [5 if i % 10 == 0 else 0 for i in range(60)]))  # 90% zeros: two-stage
    # a day without demand is absent, but for the ends
    return [r for r in rows if r[2] > 0 or r[1] in (dt.date(2024, 1, 1), dt.date(2024, 2, 29))]


def test_train_all_status_and_routes(spark):
    p = Params().with_(gbt_trees=2, gbt_depth=2, min_train=30, train_points=6)
    daily = spark.createDataFrame(_daily(), "item_id long, ds date, qty double")
    lead = spark.createDataFrame([(2, 5.0), (4, 9.0)], "item_id long, mean_days double")
    results, routed = M.train_all(daily, p, lead=lead)
    got = {r["part_id"]: r for r in results.collect()}
    assert got[1]["status"] == "insufficient_data" and got[1]["mae"] is None
    assert got[1]["error"] == "Only 5 data points"
    assert got[5]["status"] == "insufficient_valid_data" and got[5]["error"] == "Only 12 valid samples"
    assert {got[i]["status"] for i in (2, 3, 4)} == {"success"}
    assert got[2]["model_route"] == "tweedie_1.3" and got[3]["model_route"] == "tweedie_1.7"
    assert got[4]["model_route"] == "two_stage"
    assert all(got[i]["mae"] is not None and got[i]["mae"] >= 0 for i in (2, 3, 4))
    assert got[2]["train_samples"] == 48 and got[2]["val_samples"] == 12   # 80 / 20 of 60 rows
    assert set(routed.models) == {"tweedie_1.3", "tweedie_1.7", "two_stage"}
    assert "lt_mean_days" in routed.names


def test_routed_models_are_saved_and_loaded(spark, tmp_path):
    p = Params().with_(gbt_trees=2, gbt_depth=2, min_train=30, train_points=6)
    daily = spark.createDataFrame(_daily(), "item_id long, ds date, qty double")
    _, routed = M.train_all(daily, p)
    back = M.Routed.load(spark, routed.save(spark, f"file://{tmp_path}/routed"))
    assert back.names == routed.names and set(back.models) == set(routed.models)
    data, _ = M.routed_vectors(daily, p)
    for route in routed.models:
        part = data.where(data.model_route == route)
        a, b = (sorted((r["item_id"], r["ds"], r["yhat"]) for r in M.score(x.models[route], part).collect()) for x in (routed, back))
        assert a == b


def test_a_route_without_demand_is_an_error_row(spark):
    p = Params().with_(min_train=30, train_points=2)
    daily = spark.createDataFrame(_series(1, [0] * 40), "item_id long, ds date, qty double")
    row = M.train_all(daily, p)[0].first()
    assert row["status"] == "error" and "no positive demand" in row["error"] and row["mae"] is None


def test_penalty_lowers_underforecasts(spark):
    # an irregular series and shallow trees: what cannot be learned is where a penalty counts
    p = Params().with_(min_train=30, train_points=6, gbt_trees=2, gbt_depth=2, loss_trees=6)
    rows = _series(2, [i * i * 7919 % 1009 % 9 + 1 for i in range(160)])
    daily = spark.createDataFrame(rows, "item_id long, ds date, qty double")
    data, _ = M.routed_vectors(daily, p)
    plain, strict = (M._fit_route(data, p, 1.3, x) for x in (1.0, 5.0))
    short = [M.score(m, data).where("qty > yhat").count() for m in (plain, strict)]
    assert short[1] < short[0]


def test_global_model_beats_the_last_value(spark):
    """A weekly pattern: one global model, forecast 14 days, against repeating the last day."""
    p = Params().with_(gbt_trees=30, gbt_depth=3)
    rows = [r for item in range(1, 7) for r in _series(item, [10 * item if d % 7 == 2 else item for d in range(150)])]
    dense = spark.createDataFrame(rows, "item_id long, ds date, qty double")
    sup = M.supervised(dense, p.n_lags, p.horizon).cache()
    model = M.fit_global_gbt(sup.where("split = 'train'"), p)
    fc = M.recursive_forecast(model, sup, p, sup.split == "train").join(dense, ["item_id", "ds"])
    last = {item: vals for item, vals in ((i, 10 * i if (150 - 15) % 7 == 2 else i) for i in range(1, 7))}
    got = fc.collect()
    assert len(got) == 6 * 14
    mae = sum(abs(r["qty"] - r["yhat"]) for r in got) / len(got)
    naive = sum(abs(r["qty"] - last[r["item_id"]]) for r in got) / len(got)
    assert mae < 0.5 * naive


def test_backtest_reaches_the_end_of_every_series(spark):
    from partcast.operators.backtest import backtest_ml

    p = Params().with_(gbt_trees=2, gbt_depth=2, n_lags=5)
    rows = _series(1, [d % 5 for d in range(20)]) + _series(2, [d % 3 + 1 for d in range(44)])
    got = {r["item_id"]: r for r in backtest_ml(spark.createDataFrame(rows, "item_id long, ds date, qty double"), p, steps=7).collect()}
    # cut-offs at 16, 23, 30, 37: the first item has the first alone
    assert got[1]["n_folds"] == 1 and got[2]["n_folds"] == 4
    assert all(r["mae_min"] <= r["mae_mean"] <= r["mae_max"] and r["mape_mean"] is not None for r in got.values())
