"""Registered queries: Spark ML forecasters, back-test, loss comparison, model
and report sinks (SURVEY 2.9, 2.1 sinks, 2.10 ``compare_loss``).

The registered learned keys return what does not depend on the fitting algorithm
(items, days, actual values, routes, and whether every forecast is a usable number),
so each has an exact oracle; accuracy itself is held to bounds by the tests.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from partcast.operators import backtest as BT
from partcast.operators import classify as K
from partcast.operators import evaluate as E
from partcast.operators import leadtime as L
from partcast.operators import linear as N
from partcast.operators import ml as M
from partcast.operators import procure as Q
from partcast.operators import quality as D
from partcast.operators import reshape as R
from partcast.operators.boosting import Boosted
from partcast.operators.extract import window_start
from partcast.plans import cat_procure, cat_quality  # noqa: F401  (queries of the report's sheets)
from partcast.plans.oracle_base import AS_OF, own_span
from partcast.plans.registry import EP, P, REGISTRY, register
from partcast.plans.sqlkit import cte, sql
from partcast.plans.sqlsolve import autoregression
from partcast.session import cut_lineage, ensure_checkpoint_dir, written
from partcast.sources import files as IO


def _train():
    return F.col("split") == "train"


def _sup(t, holdout=P.horizon, subset=False):
    """Supervised rows of total demand per item, written once to shared storage."""
    dense = cut_lineage(R.dense_series(t, P, "total", "own"))
    if subset:
        trainable = M.at_least(dense, P.n_lags + holdout + 1)
        cats = K.volume_class(R.demand_total(t, P), P.days_back + 1).join(trainable, "item_id", "left_semi")
        dense = M.select_subset(dense, cats)
    return written(M.supervised(dense, P.n_lags, holdout))


def _place(t, name, rows):
    """Where what is made of these rows is kept: the shared folder, under the session and a
    fingerprint of the rows and parameters; and whether it is there."""
    print_of = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("item_id", "ds", "qty").cast("decimal(38,0)"))).first()
    key = hashlib.sha256(repr((name, tuple(print_of), P)).encode()).hexdigest()[:24]
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/partcast-models/{t.spark.conf.get('spark.app.id')}/{name}-{key}"
    try:
        t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return path, True
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return path, False


def _fitted_at(t, name, rows, fit):
    """Path of the model of this name for these rows, fitted by the first query that asks."""
    path, there = _place(t, name, rows)
    return path if there else M.save_model(fit(), path)


def _fitted(t, name, rows, fit):
    return M.load_model(_fitted_at(t, name, rows, fit))


def _holdout_model(t):
    sup = _sup(t)
    rows = sup.where(_train())
    return _fitted(t, "gbt_holdout", rows, lambda: M.fit_global_gbt(rows, P)), sup


def _full_model(t):
    sup = _sup(t, 0)
    return _fitted(t, "gbt_full", sup, lambda: M.fit_global_gbt(sup, P)), sup


def _lead(t):
    return L.lead_time_stats(L.lead_times(L.purchases_in_window(t.purchases, None, P.as_of))).groupBy("item_id").agg(
        F.avg("lead_time_mean").alias("mean_days"), F.max("order_count").alias("orders"))


def _fine(c="yhat"):
    """A forecast that is a finite number and not below zero."""
    return (F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf"))).alias("fine")


def _with_actual(fc, sup):
    """The forecasts with the demand of their days, the hold-out rows of ``sup``.  Both are
    shuffled: the dense days are estimated by the few observed ones, so Spark would take them
    for small and broadcast them all."""
    actual = sup.where(F.col("split") == "test").select("item_id", "ds", F.col("qty").alias("y"))
    return fc.join(actual.hint("merge"), ["item_id", "ds"], "left")


cte("total_daily", """
SELECT item_id, ds, sum(qty) AS qty
FROM (SELECT item_id, ds, qty FROM parts_daily UNION ALL SELECT item_id, ds, sales_qty AS qty FROM sales_d) u
WHERE item_id IS NOT NULL GROUP BY 1, 2""", "parts_daily", "sales_d")
own_span("total_dense", "total_daily")
cte("total_pos", """
SELECT item_id, ds, qty, row_number() OVER (PARTITION BY item_id ORDER BY ds) - 1 AS rn,
       count(*) OVER (PARTITION BY item_id) AS n FROM total_dense""", "total_dense")
cte("total_holdout", f"""
SELECT item_id, rn - (n - {P.horizon}) + 1 AS h, ds, qty AS y FROM total_pos
WHERE n - {P.horizon} - 1 >= {P.n_lags} AND rn >= n - {P.horizon}""", "total_pos")
cte("total_class", f"""
SELECT item_id, sum(qty) > 1000 OR count_if(qty > 0) / {float(P.days_back + 1)} > 0.3 AS wanted FROM total_daily
WHERE item_id IN (SELECT item_id FROM total_holdout) GROUP BY 1""", "total_daily", "total_holdout")
cte("total_subset", """
SELECT item_id FROM total_class WHERE wanted OR NOT EXISTS (SELECT 1 FROM total_class WHERE wanted)""", "total_class")
cte("total_one_step", "SELECT item_id, ds, y AS qty FROM total_test", "total_test")
cte("total_test", f"""
SELECT item_id, ds, qty AS y FROM total_pos WHERE rn >= {P.n_lags} AND rn >= n - {P.horizon}""", "total_pos")


@register("ml_multiseries", sql("SELECT item_id, h, ds, y, true AS fine FROM total_holdout", "total_holdout"))
def _ml_multiseries(t):
    model, sup = _holdout_model(t)
    fc = _with_actual(M.recursive_forecast(model, sup, P, _train()), sup)
    return fc.select("item_id", "h", "ds", "y", _fine())


@register("ml_multiseries_subset", sql("""
SELECT item_id, h, ds, y, true AS fine FROM total_holdout WHERE item_id IN (SELECT item_id FROM total_subset)""",
    "total_holdout", "total_subset"))
def _ml_multiseries_subset(t):
    sup = _sup(t, subset=True)
    rows = sup.where(_train())
    model = _fitted(t, "gbt_subset", rows, lambda: M.fit_global_gbt(rows, P))
    fc = _with_actual(M.recursive_forecast(model, sup, P, _train()), sup)
    return fc.select("item_id", "h", "ds", "y", _fine())


autoregression("single_fit", "total_pos", f"n - {P.horizon}", P.horizon)


@register("ml_single_series", sql(f"""
SELECT item_id, count(*) AS n_points, avg(abs(qty - yhat)) AS mae, sqrt(avg((qty - yhat) * (qty - yhat))) AS rmse
FROM single_fit WHERE item_id IN (SELECT item_id FROM total_daily WHERE qty > 0 GROUP BY item_id HAVING count(*) >= {P.single_days})
GROUP BY item_id""", "single_fit", "total_daily"))
def _ml_single_series(t):
    """A model of its own for every item with enough demand days, and its hold-out errors."""
    dense = R.dense_series(t, P, "total", "own")
    return N.single_series(M.eligible_nonzero(dense, P.single_days), P.horizon).drop("coef")


cte("routed", """
SELECT x.*, CASE WHEN z < 50 THEN 'tweedie_1.3' WHEN z < 80 THEN 'tweedie_1.7' ELSE 'two_stage' END AS route
FROM (SELECT d.item_id, d.ds, d.qty, row_number() OVER (PARTITION BY d.item_id ORDER BY d.ds) - 1 AS rn, count(*) OVER w AS n,
             avg(CASE WHEN d.qty = 0 THEN 1.0 ELSE 0.0 END) OVER w * 100 AS z, o.points
      FROM total_dense d JOIN (SELECT item_id, count(DISTINCT ds) AS points FROM total_daily GROUP BY 1) o ON d.item_id = o.item_id
      WINDOW w AS (PARTITION BY d.item_id)) x""", "total_dense", "total_daily")
cte("routed_events", """
SELECT x.*, CASE WHEN z < 50 THEN 1.3 WHEN z < 80 THEN 1.7 END AS tweedie_power
FROM (SELECT d.item_id, d.ds, d.qty, row_number() OVER (PARTITION BY d.item_id ORDER BY d.ds) - 1 AS rn, count(*) OVER w AS n,
             avg(CASE WHEN d.qty = 0 THEN 1.0 ELSE 0.0 END) OVER w * 100 AS z, o.points
      FROM events_all_dense d JOIN (SELECT item_id, count(DISTINCT ds) AS points FROM events_all_daily GROUP BY 1) o ON d.item_id = o.item_id
      WINDOW w AS (PARTITION BY d.item_id)) x""", "events_all_dense", "events_all_daily")


@register("ml_tweedie", sql(f"""
SELECT item_id, ds, qty, tweedie_power, true AS fine FROM routed_events
WHERE points >= {EP.train_points} AND n >= {EP.min_train} AND tweedie_power IS NOT NULL AND rn >= floor(n * 0.8)""", "routed_events"))
def _ml_tweedie(t):
    return M.tweedie_by_route(R.demand_source(t, EP, "events_all"), EP).select("item_id", "ds", "qty", "tweedie_power", _fine())


@register("ml_two_stage", sql(f"""
SELECT item_id, ds, qty, true AS fine FROM routed WHERE points >= {P.train_points} AND n >= {P.min_train} AND rn >= floor(n * 0.8)""", "routed"))
def _ml_two_stage(t):
    data, _ = M.routed_vectors(R.demand_total(t, P), P)
    models = M.fit_two_stage_on(data.where(_train()), P)
    s = M.score(models, data.where(F.col("split") == "validation"))
    return s.select("item_id", "ds", "qty", _fine())


@register("ml_asymmetric", sql("SELECT item_id, ds, qty, true AS fine FROM total_one_step", "total_one_step"))
def _ml_asymmetric(t):
    """Standard and penalised boosted models, one step ahead."""
    model, sup = _holdout_model(t)
    rows = sup.where(_train())
    asym = Boosted.load(t.spark, _fitted_at(t, "boosted_asymmetric", rows, lambda: M.fit_asymmetric(rows, P, 3.0)))
    both = M.one_step(model, sup, asym).withColumn("least", F.least("yhat", "yhat_1"))
    return both.select("item_id", "ds", "qty", _fine("least"))


@register("ml_train_all", sql(f"""
SELECT item_id AS part_id, status, zero_pct, model_route,
       CASE WHEN status = 'success' THEN CAST(floor(n * 0.8) AS BIGINT) END AS train_samples,
       CASE WHEN status = 'success' THEN n - CAST(floor(n * 0.8) AS BIGINT) END AS val_samples,
       CASE status WHEN 'insufficient_data' THEN 'Only ' || points || ' data points'
                   WHEN 'insufficient_valid_data' THEN 'Only ' || n || ' valid samples' END AS error,
       status = 'success' AS has_mae
FROM (SELECT item_id, route AS model_route, z AS zero_pct, n, points, CASE WHEN points < {P.train_points} THEN 'insufficient_data'
        WHEN n < {P.min_train} THEN 'insufficient_valid_data' ELSE 'success' END AS status
      FROM routed WHERE rn = 0) x""", "routed"))
def _ml_train_all(t):
    return _trained(t)[0].select("part_id", "status", "zero_pct", "model_route", "train_samples", "val_samples", "error",
                                 F.coalesce(F.col("mae") >= 0, F.lit(False)).alias("has_mae"))


def _trained(t):
    """Results of training every part, and the path of the routes' models."""
    daily = R.demand_total(t, P)
    path, there = _place(t, "train_all", daily)
    if not there:
        results, routed = M.train_all(daily, P, lead=_lead(t))
        routed.save(t.spark, f"{path}/models")
        results.write.parquet(f"{path}/results")
    return t.spark.read.parquet(f"{path}/results"), f"{path}/models"


def _importances(t):
    """Importances in all saved models: the global one and those of the routes."""
    sup = _sup(t)
    rows = sup.where(_train())
    path = _fitted_at(t, "gbt_holdout", rows, lambda: M.fit_global_gbt(rows, P))
    return M.importances(t.spark, [*M.catalogue(t.spark, _trained(t)[1]), ("global_gbt", f"{path}/stages/*GBT*", M.feature_names(P.n_lags))])


_ROUTE_MODELS = {"tweedie_1.3": ("tweedie_1.3_model",), "tweedie_1.7": ("tweedie_1.7_model",), "two_stage": ("two_stage_classifier", "two_stage_regressor")}
# The feature names of the routes' models.
_ROUTE_FEATURES = [*(f"{k}lag_{n}" for n in (1, 7, 14, 30) for k in ("", "had_demand_")), *(f"rolling_{k}_{n}" for n in (7, 14, 30) for k in ("mean", "std", "max", "min", "zero_count", "nonzero_count")),
                   *(f"intermittency_ratio_{n}" for n in (7, 14, 30)), "time_since_last_demand", "zero_run_length", "demand_run_length", "demand_concentration_7d",
                   "demand_concentration_30d", "avg_demand_interval_30d", "demand_probability_7d", "demand_probability_30d"]
# The business-day features among them.
BUSINESS = ["day_of_week", "is_monday", "is_friday", "is_weekend", "business_day_of_month", "days_since_weekend", "days_until_weekend", "month", "quarter",
            "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end", "day_sin", "day_cos", "month_sin", "month_cos"]
_quoted = lambda names: ", ".join(f"'{c}'" for c in names)


@register("ml_importance", sql(f"""
SELECT model, feature, CASE WHEN feature LIKE 'lag@_%' ESCAPE '@' OR feature LIKE 'had@_demand@_lag@_%' ESCAPE '@' THEN 'lag' ELSE 'exog' END AS kind,
       true AS sums_to_one
FROM (SELECT 'global_gbt' AS model, unnest([{_quoted(M.feature_names(P.n_lags))}]) AS feature
      UNION ALL SELECT model, unnest([{_quoted(_ROUTE_FEATURES)}, {_quoted(BUSINESS)}, 'item_code', 'lt_mean_days', 'lt_orders']) AS feature
      FROM (""" + " UNION ALL ".join(f"SELECT '{r}' AS route, '{m}' AS model" for r, ms in _ROUTE_MODELS.items() for m in ms) + f""") m
      WHERE route IN (SELECT route FROM routed WHERE points >= {P.train_points} AND n >= {P.min_train})) x""", "routed"))
def _ml_importance(t):
    """Every feature in every saved model."""
    imp = _importances(t)
    whole = F.abs(F.sum("importance").over(Window.partitionBy("model")) - 1) < 1e-9
    return imp.select("model", "feature", "kind", whole.alias("sums_to_one"))


@register("ml_importance_top")
def _ml_importance_top(t):
    """The 20 features of the highest mean importance over all models, and the shares of lags
    and of everything else."""
    return M.importance_summary(_importances(t))


@register("ml_forecast_future", sql(f"""
SELECT item_id, h, CAST(ds + CAST(h AS INTEGER) AS DATE) AS ds, true AS fine, true AS ordered
FROM (SELECT item_id, ds, unnest(range(1, {P.horizon + 1})) AS h FROM total_pos WHERE rn = n - 1 AND rn >= {P.n_lags}) x""", "total_pos"))
def _ml_forecast_future(t):
    model, sup = _full_model(t)
    fc = M.bounds(M.recursive_forecast(model, sup, P, F.lit(True)))
    return fc.select("item_id", "h", "ds", _fine(), ((F.col("lo") <= F.col("yhat")) & (F.col("yhat") <= F.col("hi"))).alias("ordered"))


@register("ml_forecast_flat", sql(f"""
SELECT item_id, h, {AS_OF} + CAST(h AS INTEGER) AS ds, true AS fine, n <= {P.n_lags} AS no_history
FROM (SELECT item_id, n, unnest(range(1, {P.horizon + 1})) AS h FROM total_pos WHERE rn = 0) x""", "total_pos"))
def _ml_forecast_flat(t):
    model, sup = _full_model(t)
    items = R.demand_total(t, P).select("item_id").distinct()
    fc = M.forecast_flat(model, sup, items, P.horizon, P.as_of)
    known = sup.select("item_id").distinct().withColumn("known", F.lit(True))
    return fc.join(known, "item_id", "left").select("item_id", "h", "ds", _fine(), F.col("known").isNull().alias("no_history"))


@register("compare_loss", sql("""
SELECT unnest([1.0, 2.0, 3.0, 5.0]) AS penalty, (SELECT count(*) FROM total_test) AS n_points, true AS no_more_stockouts""", "total_test"))
def _compare_loss(t):
    """Standard vs stock-out-penalised linear fits (exact asymmetric least squares),
    penalties 1, 2, 3, 5, on the hold-out."""
    met = compare_losses(_sup(t))
    return met.select("penalty", "n_points", (F.col("stockout_rate") <= F.first_value("stockout_rate").over(
        Window.partitionBy(F.lit(0)).orderBy("penalty"))).alias("no_more_stockouts"))      # four rows


def compare_losses(sup, penalties=(1.0, 2.0, 3.0, 5.0)):
    """Metrics per penalty and their change against the first."""
    vec = VectorAssembler(inputCols=M.lag_names(P.n_lags) + list(M.CAL_COLS), outputCol="features")
    data = written(vec.transform(sup).select("item_id", "ds", "qty", "y", "mu", "sd", "split", "features"))
    train, test = data.where(_train()), data.where(F.col("split") == "test")
    evs = None
    for pen in penalties:
        m = M.fit_expectile_linear(train, "features", "y", pen)
        ev = m.transform(test).select(
            F.lit(pen).alias("penalty"), F.col("qty").alias("y"),
            F.greatest(F.col(M.FITTED) * F.col("sd") + F.col("mu"), F.lit(0.0)).alias("yhat"))
        evs = ev if evs is None else evs.unionByName(ev)
    met = E.asymmetric_metrics(evs, ("penalty",), 3.0).join(evs.groupBy("penalty").agg(F.count(F.lit(1)).alias("n_points")), "penalty")
    w, eps = Window.partitionBy(F.lit(0)).orderBy("penalty"), E.EPS_CHANGE                 # a row per penalty

    def first(c):
        return F.first_value(c).over(w)

    return met.select(
        "*",
        ((first("stockout_rate") - F.col("stockout_rate")) / (first("stockout_rate") + eps) * 100).alias("stockout_reduction"),
        ((first("total_cost") - F.col("total_cost")) / (first("total_cost") + eps) * 100).alias("cost_reduction"),
        ((F.col("mae") - first("mae")) / (first("mae") + eps) * 100).alias("mae_change"))


@register("model_io", sql("""
SELECT o.*, true AS same, (SELECT count(*) FROM train_results WHERE status = 'success') AS saved_successes
FROM total_one_step o""", "total_one_step", "train_results"))
def _model_io(t):
    """Save the global model and the training results (partitioned by status) to
    the shared folder, read both back, and score with both copies of the model."""
    model, sup = _holdout_model(t)
    loaded = M.load_model(M.save_model(model, IO.io_path(t.spark, "model")))
    results = E.training_results_baseline(R.demand_parts(t, P), P, "MA_7")
    back = M.save_results(results, IO.io_path(t.spark, "training_results"))
    both = M.one_step(model, sup, loaded)
    good = back.where(F.col("status") == "success").agg(F.count(F.lit(1)).alias("n")).scalar()
    return both.select("item_id", "ds", "qty", (F.col("yhat") == F.col("yhat_1")).alias("same"), good.alias("saved_successes"))


# The sheets of the procurement report, the query each holds, and its columns
# (n number, d date, t text).
_ORDERS = "item_id:n total_demand:n safety_stock:n order_by_date:d priority:t"
_SHEETS = {
    "urgent_orders": ("urgent_orders", _ORDERS), "warning_orders": ("warning_orders", _ORDERS),
    "summary": ("procurement_summary", "total_items:n total_predicted_demand:n items_with_demand:n avg_daily_demand:n peak_demand_date:d forecast_horizon:n"),
    "historical_analysis": ("historical_summary", "part_id:n consumption_mean:n consumption_std:n consumption_min:n consumption_max:n consumption_count:n date_min:d date_max:d"),
    "forecasts": ("safety_stock", "item_id:n h:n ds:d predicted_demand:n safety_stock:n"),
}
_AS_NUMBER = {"n": "{0}", "d": "date_diff('day', DATE '1970-01-01', {0})", "t": "length({0})"}


def _sheet_sums() -> str:
    parts = []
    for sheet, (key, columns) in _SHEETS.items():
        for column, kind in (c.split(":") for c in columns.split()):
            parts.append(f"SELECT '{sheet}' AS sheet, '{column}' AS \"column\", count(*) AS rows, count({column}) AS filled, "
                         f"CAST(sum({_AS_NUMBER[kind].format(column)}) AS DOUBLE) AS total FROM ({REGISTRY[key].sql.body}) s")
    return "\nUNION ALL\n".join(parts)


@register("report_tables", sql(_sheet_sums(), "fut_ss", "parts_dense"))
def _report_tables(t):
    fc = Q.safety_stock(Q.future_forecast(R.demand_parts(t, P), P, "MA_NonZero", window_start(P), P.as_of), P.safety_factor)
    sheets = {
        "urgent_orders": Q.urgent_orders(fc, P.as_of, P.urgent_days),
        "warning_orders": Q.warning_orders(fc, P.as_of, P.urgent_days, P.warning_days),
        "summary": Q.procurement_summary(fc, P.horizon),
        "historical_analysis": D.historical_summary(R.dense_series(t, P, "parts", "own")),
        "forecasts": fc,
    }
    return IO.report_tables(sheets, "procurement_report")


W = "PARTITION BY item_id ORDER BY ds"
cte("bt_pos", """
SELECT *, CASE WHEN rn >= floor(n * 0.8) THEN CAST(floor((rn - floor(n * 0.8)) / 7) AS BIGINT) END AS fold,
       rn >= floor(n * 0.8) AND (rn - floor(n * 0.8)) % 7 = 0 AS at_cut
FROM parts_fixed_pos""", "parts_fixed_pos")
_cut = {
    "MA_7": f"avg(qty) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)",
    "MA_14": f"avg(qty) OVER ({W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)",
    "MA_30": f"avg(qty) OVER ({W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)",
    "Naive": f"lag(qty, 1) OVER ({W})",
    "Mean": f"avg(qty) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
}
cte("bt_cut", "SELECT *, " + ", ".join(f"CASE WHEN at_cut THEN {e} END AS c_{m}" for m, e in _cut.items())
    + " FROM bt_pos", "bt_pos")
cte("bt_rows", "\nUNION ALL\n".join(
    f"SELECT item_id, fold, qty, '{m}' AS method, last_value(c_{m} IGNORE NULLS) OVER "
    f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS yhat FROM bt_cut" for m in _cut), "bt_cut")


@register("backtest", sql("""
SELECT item_id, method, count(*) AS n_folds, avg(fold_mae) AS mae_mean, stddev_samp(fold_mae) AS mae_std,
       min(fold_mae) AS mae_min, max(fold_mae) AS mae_max
FROM (SELECT item_id, method, fold, avg(abs(qty - yhat)) AS fold_mae FROM bt_rows WHERE fold IS NOT NULL
      GROUP BY item_id, method, fold) f
GROUP BY item_id, method""", "bt_rows"))
def _backtest(t):
    return BT.backtest_baselines(R.dense_series(t, P, "parts", "fixed"))


autoregression("refit", "parts_fixed_pos", "floor(n * 0.8)", 7)


@register("backtest_refit", sql("""
SELECT item_id, count(*) AS n_folds, avg(mae) AS mae_mean, stddev_samp(mae) AS mae_std, min(mae) AS mae_min, max(mae) AS mae_max,
       avg(mape) AS mape_mean, stddev_samp(mape) AS mape_std, min(mape) AS mape_min, max(mape) AS mape_max
FROM (SELECT item_id, part, avg(abs(qty - yhat)) AS mae, avg(abs(qty - round(yhat, 6)) / (qty + 1e-8)) * 100 AS mape
      FROM refit GROUP BY item_id, part) f
GROUP BY item_id""", "refit"))
def _backtest_refit(t):
    return N.backtest_refit(R.dense_series(t, P, "parts", "fixed"))
