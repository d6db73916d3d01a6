"""Work and memory that stay in proportion: partitions of filled series, sorts of dense rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from partcast.operators import baselines as B
from partcast.operators import linear as N
from partcast.operators import ml as M
from partcast.operators import reshape as R
from partcast.plans.registry import P
from partcast.session import written
from partcast.sources.tables import Tables

START = dt.date(2001, 1, 1)


def daily(spark, items, days=40):
    """Every fifth day of each item has demand, from the first day to the last."""
    rows = [(i, START + dt.timedelta(days=d), float(1 + (i + d) % 4)) for i in range(items) for d in range(0, days, 5)]
    return spark.createDataFrame(rows, "item_id long, ds date, qty double")


@pytest.fixture
def merging(spark):
    """A session that merges small partitions, as Spark's default does."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    yield spark
    spark.conf.set(key, before)


def first_above(df, node, among):
    """For each ``node`` in the plan, the nearest operator above it that is one of ``among``."""
    lines, out = df._jdf.queryExecution().sparkPlan().toString().splitlines(), []
    for at, line in enumerate(lines):
        if node in line:
            depth, found = len(line) - len(line.lstrip(" :+-")), None
            for up in reversed(lines[:at]):
                d = len(up) - len(up.lstrip(" :+-"))
                if d < depth:
                    depth, found = d, next((a for a in among if up.lstrip(" :+-").startswith(a)), None)
                    if found:
                        break
            out.append(found)
    return out


def test_filled_series_are_spread(merging):
    few = daily(merging, 30).groupBy("item_id", "ds").agg(F.sum("qty").alias("qty"))
    for dense in (R.densify_own_span(few), R.densify_fixed_window(few, START, START + dt.timedelta(days=39))):
        parts = [r["count"] for r in dense.groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) >= 6 and max(parts) < sum(parts) / 2


def test_baseline_select_windows_see_no_filled_days(spark):
    dense = R.densify_fixed_window(daily(spark, 3), START, START + dt.timedelta(days=39))
    above = first_above(B.baseline_select(dense, P), "Generate explode", ("Window", "HashAggregate", "Filter"))
    assert above and "Window" not in above


def test_baseline_select_against_plain_python(spark):
    """Items with demand in the scored days, without any, and without demand at all."""
    data = {1: [0.0, 0.0, 6.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0], 2: [3.0] * 10, 3: [0.0] * 10, 4: [5.0], 5: [4.0, 0.0, 0.0, 0.0, 0.0] * 4}
    rows = [(i, START + dt.timedelta(days=d), q) for i, v in data.items() for d, q in enumerate(v)]
    got = {r["item_id"]: r for r in B.baseline_select(spark.createDataFrame(rows, "item_id long, ds date, qty double"), P).collect()}
    assert set(got) == {1, 2, 3, 5}                       # a single day leaves nothing to fit
    assert got[2]["selected_method"] == "MA_7" and got[2]["yhat"] == 3.0 and got[2]["validation_mae"] == 0.0
    assert got[3]["selected_method"] == "Ensemble" and got[3]["zero_pct"] == 100.0 and got[3]["validation_mae"] == 0.0
    assert got[1]["zero_pct"] == 7 / 8 * 100 and got[5]["zero_pct"] == 75.0 and got[5]["selected_method"] == "SBA"
    for i, late in ((1, [2.0, 0.0]), (5, data[5][16:])):
        y = got[i]["yhat"]
        assert got[i]["validation_mae"] == pytest.approx(sum(abs(q - y) for q in late) / len(late))


def test_refits_sort_no_wide_rows(spark):
    """The sums are hashed: an aggregate that also collects would sort all rows with their features."""
    dense = R.densify_fixed_window(daily(spark, 3, 100), START, START + dt.timedelta(days=99))
    plan = N.backtest_refit(dense)._jdf.queryExecution().sparkPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_refits_move_the_series_only(spark):
    """The sums and the days of a fold meet where they are: no exchange but the series' own."""
    dense = R.densify_fixed_window(daily(spark, 3, 100), START, START + dt.timedelta(days=99))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = N.backtest_refit(dense)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "SortMergeJoin" in plan and ", part#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    assert all("item_id" in x or "_item" in x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_expectile_fits_write_nothing(spark):
    """A row's weight follows from the fit before: no copy of the rows per fit."""
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([float(i % 7), float(i % 5)]), float((i * i) % 11)) for i in range(200)]
    train = spark.createDataFrame(rows, ["features", "y"])
    kept = spark.conf.get("spark.checkpoint.dir")
    files = lambda: sum(len(f) for _, _, f in os.walk(kept.removeprefix("file:")))
    before = files()
    model = M.fit_expectile_linear(train, "features", "y", 3.0)
    assert files() == before
    off = [(y - model.predict(x), x) for x, y in rows]
    for c in (lambda x: 1.0, lambda x: x[0], lambda x: x[1]):            # the weighted residuals are balanced
        assert sum((3.0 if r > 0 else 1.0) * r * c(x) for r, x in off) == pytest.approx(0.0, abs=1e-6)


def test_written_rows_are_the_same(spark):
    df = daily(spark, 4).withColumn("lag", F.lit(-0.25))
    back = written(df)
    assert back.columns == df.columns and back.exceptAll(df).count() == 0 and back.count() == df.count()


def supervised(spark, p, items=30, days=60):
    dense = R.densify_own_span(daily(spark, items, days).groupBy("item_id", "ds").agg(F.sum("qty").alias("qty")))
    return written(M.supervised(dense, p.n_lags, p.horizon))


def test_forecasts_are_spread(merging):
    p = P.with_(gbt_trees=2, gbt_depth=2, n_lags=5)
    sup = supervised(merging, p)
    model = M.fit_global_gbt(sup.where("split = 'train'"), p)
    fc = M.recursive_forecast(model, sup, p, F.col("split") == "train")
    parts = [r["count"] for r in fc.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) >= 6 and sum(parts) == 30 * p.horizon


def test_actual_days_are_not_broadcast(merging, monkeypatch):
    """Forecasts meet the hold-out days in a shuffle, though the few observed days look small."""
    from partcast.plans import cat_ml

    p = P.with_(gbt_trees=2, gbt_depth=2, n_lags=5)
    monkeypatch.setattr(cat_ml, "P", p)
    sup = supervised(merging, p)
    monkeypatch.setattr(cat_ml, "_holdout_model", lambda t: (M.fit_global_gbt(sup.where("split = 'train'"), p), sup))
    t = Tables(merging, "/root/testdata/sf0.001")
    df = cat_ml._ml_multiseries(t)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    want = {(r["item_id"], r["ds"]): r["qty"] for r in sup.where("split = 'test'").collect()}
    assert {(r["item_id"], r["ds"]): r["y"] for r in rows} == want and len(rows) == len(want) == 30 * p.horizon


def test_two_models_score_in_one_pass(spark):
    p = P.with_(gbt_trees=2, gbt_depth=2, n_lags=5, loss_trees=2)
    sup = supervised(spark, p, 6)
    train = sup.where("split = 'train'")
    one, other = M.fit_global_gbt(train, p), M.fit_asymmetric(train, p)
    both = M.one_step(one, sup, other)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    got = {(r["item_id"], r["ds"]): (r["yhat"], r["yhat_1"]) for r in both.collect()}
    alone = [{(r["item_id"], r["ds"]): r["yhat"] for r in M.one_step(m, sup).collect()} for m in (one, other)]
    assert got == {k: (alone[0][k], alone[1][k]) for k in alone[0]} and len(got) == 6 * p.horizon


def test_routed_features_are_spread(merging):
    """The parts that may train are picked by a join; the features are still made in all partitions."""
    few = daily(merging, 30, 60).groupBy("item_id", "ds").agg(F.sum("qty").alias("qty"))
    data, _ = M.routed_vectors(few, P)
    assert data.rdd.getNumPartitions() >= 6 and data.select("item_id").distinct().count() == 30
