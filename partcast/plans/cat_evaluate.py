"""Registered queries: forecast evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from partcast.operators import baselines as B
from partcast.operators import classify as K
from partcast.operators import evaluate as E
from partcast.operators import reshape as R
from partcast.operators.extract import window_start
from partcast.plans import cat_forecast  # noqa: F401  (registers the forecast CTEs)
from partcast.plans.registry import P, register
from partcast.plans.sqlkit import cte, sql

CLASSIC = ("MA_7", "MA_14", "MA_30", "WMA_7", "Naive", "Seasonal_7", "ExpSmooth")


def eval_ctes(prefix: str) -> None:
    cte(f"{prefix}_eval", f"""
SELECT f.item_id, f.method, f.h, f.ds, t.qty AS y, f.yhat
FROM {prefix}_all f JOIN {prefix}_test t ON f.item_id = t.item_id AND f.ds = t.ds""",
        f"{prefix}_all", f"{prefix}_test")
    cte(f"{prefix}_metrics", f"""
SELECT item_id, method, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
       avg(abs((y - yhat) / (y + 1e-8))) * 100 AS mape, count(*) AS n_points
FROM {prefix}_eval GROUP BY item_id, method""", f"{prefix}_eval")


eval_ctes("fc")
eval_ctes("fco")
cte("best_classic", f"""
SELECT item_id, method AS best_method, mae AS best_mae FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(mae, 9), method) AS r
  FROM fc_metrics WHERE method IN ({', '.join(repr(m) for m in CLASSIC)}) AND mae IS NOT NULL) x WHERE r = 1""",
    "fc_metrics")


def _ev(t, span="fixed"):
    """Hold-out evaluation rows computed on the sparse daily sums: the fixed
    span is the trailing window, the own span each part's first to last day."""
    if span == "fixed":
        return B.evaluation_rows(R.demand_parts(t, P), P, start=window_start(P), end=P.as_of)
    return B.evaluation_rows(R.demand_parts(t, P), P)


@register("metrics_mae_rmse", sql("SELECT item_id, method, mae, rmse FROM fc_metrics", "fc_metrics"))
def _mae_rmse(t):
    return E.mae_rmse(_ev(t))


@register("metrics_mape", sql("SELECT item_id, method, mape FROM fc_metrics", "fc_metrics"))
def _mape(t):
    return E.mape(_ev(t))


@register("metrics_intermittent", sql("""
SELECT *, abs(total_forecast - total_actual) / (total_actual + 1e-8) * 100 AS forecast_error_pct
FROM (SELECT item_id, method, count_if(y = 0 AND yhat = 0) AS correct_zeros,
             count_if(y > 0 AND yhat > 0) AS correct_direction, sum(yhat) AS total_forecast,
             sum(y) AS total_actual
      FROM fc_eval GROUP BY item_id, method) g""", "fc_eval"))
def _intermittent(t):
    return E.intermittent_metrics(_ev(t))


@register("metrics_inventory", sql("""
SELECT item_id, method, CAST(count_if(y - yhat > 0) AS DOUBLE) / count(*) AS stockout_rate,
       COALESCE(avg(CASE WHEN y - yhat > 0 THEN y - yhat END), 0.0) AS avg_stockout,
       COALESCE(avg(CASE WHEN y - yhat < 0 THEN yhat - y END), 0.0) AS avg_overstock,
       COALESCE(sum(CASE WHEN y - yhat > 0 THEN y - yhat END), 0.0) * 3.0
         + COALESCE(sum(CASE WHEN y - yhat < 0 THEN yhat - y END), 0.0) * 1.0 AS total_cost,
       1.0 - CAST(count_if(y - yhat > 0) AS DOUBLE) / count(*) AS service_level
FROM fc_eval GROUP BY item_id, method""", "fc_eval"))
def _inventory(t):
    return E.inventory_metrics(_ev(t))


@register("metrics_asymmetric", sql("""
SELECT *, stockout_cost + overstock_cost AS total_cost FROM (
SELECT item_id, method, avg(abs(y - yhat)) AS mae,
       CAST(count_if(y - yhat > 0) AS DOUBLE) / count(*) AS stockout_rate,
       CAST(count_if(y - yhat < 0) AS DOUBLE) / count(*) AS overstock_rate,
       COALESCE(sum(CASE WHEN y - yhat > 0 THEN y - yhat END), 0.0) * 3.0 AS stockout_cost,
       COALESCE(sum(CASE WHEN y - yhat < 0 THEN yhat - y END), 0.0) * 1.0 AS overstock_cost,
       avg(CASE WHEN y - yhat > 0 THEN 3.0 ELSE 1.0 END * (y - yhat) * (y - yhat)) AS asymmetric_loss
FROM fc_eval GROUP BY item_id, method) g""", "fc_eval"))
def _asymmetric(t):
    return E.asymmetric_metrics(_ev(t))


@register("best_method", sql("""
SELECT item_id, method AS best_method, mae AS best_mae FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(mae, 9), method) AS r
  FROM fc_metrics WHERE mae IS NOT NULL) x WHERE r = 1""", "fc_metrics"))
def _best_method(t):
    return E.best_method(E.error_metrics(_ev(t)))


@register("method_leaderboard", sql("""
SELECT *, row_number() OVER (ORDER BY round(mean_mae, 9), method) AS rank
FROM (SELECT method, avg(mae) AS mean_mae, stddev_samp(mae) AS std_mae, count(*) AS n_items
      FROM fc_metrics GROUP BY method) g""", "fc_metrics"))
def _leaderboard(t):
    return E.method_leaderboard(E.error_metrics(_ev(t)))


@register("compare_vs_baseline", sql("""
SELECT c.item_id, c.mae AS candidate_mae, b.best_method AS best_baseline, b.best_mae AS baseline_mae,
       (b.best_mae - c.mae) * 100 / nullif(b.best_mae, 0.0) AS improvement_pct,
       c.mae < b.best_mae AS candidate_wins
FROM (SELECT item_id, mae FROM fc_metrics WHERE method = 'TSB') c JOIN best_classic b ON c.item_id = b.item_id""",
    "fc_metrics", "best_classic"))
def _compare_vs_baseline(t):
    m = E.error_metrics(_ev(t))
    cand = m.where(F.col("method") == "TSB")
    return E.compare_vs_baseline(cand, m.where(F.col("method").isin(*CLASSIC)))


@register("multiseries_metrics", sql(f"""
SELECT 'overall' AS grain, CAST(NULL AS VARCHAR) AS key, avg(abs(y - yhat)) AS mae, CAST(NULL AS DOUBLE) AS mape,
       count(DISTINCT item_id) AS n_items FROM fc_eval WHERE method = 'ExpSmooth'
UNION ALL
SELECT 'series', CAST(item_id AS VARCHAR), mae, mape, 1 FROM fc_metrics WHERE method = 'ExpSmooth'
UNION ALL
SELECT 'series_mean', NULL, avg(mae), NULL, count(*) FROM fc_metrics WHERE method = 'ExpSmooth'
UNION ALL
SELECT 'category', v.category, avg(m.mae), NULL, count(*)
FROM fc_metrics m JOIN (SELECT item_id, CASE WHEN sum(qty) > 1000 THEN 'high_volume'
                                          WHEN count_if(qty > 0) / {float(P.days_back + 1)} > 0.3 THEN 'regular'
                                          WHEN count_if(qty > 0) / {float(P.days_back + 1)} > 0.1 THEN 'intermittent'
                                          ELSE 'very_intermittent' END AS category
                       FROM parts_fixed GROUP BY item_id) v ON m.item_id = v.item_id
WHERE m.method = 'ExpSmooth' GROUP BY v.category""", "fc_eval", "fc_metrics", "parts_fixed"))
def _multiseries_metrics(t):
    ev = _ev(t).where(F.col("method") == "ExpSmooth")
    cats = K.volume_class(R.demand_parts(t, P), P.days_back + 1)
    return E.multiseries_metrics(ev, cats)


@register("model_performance_table", sql(f"""
SELECT m.item_id, m.mae, m.rmse, m.mape, v.annual_consumption, v.annual_consumption / 365.0 AS avg_daily_consumption,
       CAST(NULL AS VARCHAR) AS failure_reason
FROM fco_metrics m LEFT JOIN (SELECT item_id, sum(qty) AS annual_consumption FROM parts_dense GROUP BY item_id) v
  ON m.item_id = v.item_id
WHERE m.method = 'ExpSmooth'
UNION ALL
SELECT item_id, NULL, NULL, NULL, NULL, NULL, 'insufficient_data'
FROM parts_dense_pos WHERE rn = 0 AND n - {P.horizon} < {P.min_train}""",
    "fco_metrics", "parts_dense", "parts_dense_pos"))
def _model_performance_table(t):
    dense = R.dense_series(t, P, "parts", "own")
    m = E.error_metrics(_ev(t, "own")).where(F.col("method") == "ExpSmooth")
    vols = dense.groupBy("item_id").agg(F.sum("qty").alias("annual_consumption"))
    n = dense.groupBy("item_id").count()
    failures = (n.where(F.col("count") - P.horizon < P.min_train)
                .select("item_id", F.lit("insufficient_data").alias("failure_reason")))
    return E.model_performance_table(m.drop("method", "n_points"), vols, failures)


cte("train_results", f"""
SELECT s.item_id AS part_id, CASE WHEN o.points < {P.train_points} THEN 'insufficient_data'
            WHEN s.n < {P.min_train} THEN 'insufficient_valid_data' ELSE 'success' END AS status,
       s.zero_pct, CASE WHEN o.points >= {P.train_points} AND s.n >= {P.min_train} THEN v.mae END AS mae
FROM (SELECT item_id, count(DISTINCT ds) AS points FROM parts_daily GROUP BY item_id) o JOIN (SELECT item_id, max(n) AS n, avg(CASE WHEN qty = 0 THEN 1.0 ELSE 0.0 END) * 100 AS zero_pct
      FROM parts_dense_pos GROUP BY item_id) s ON o.item_id = s.item_id
LEFT JOIN (SELECT x.item_id, avg(abs(x.qty - c.yhat)) AS mae
           FROM parts_dense_pos x
           JOIN (SELECT item_id, avg(CASE WHEN rn >= floor(n * 0.8) - 7 AND rn < floor(n * 0.8) THEN qty END) AS yhat
                 FROM parts_dense_pos WHERE n >= {P.min_train} GROUP BY item_id) c ON x.item_id = c.item_id
           WHERE x.rn >= floor(x.n * 0.8) GROUP BY x.item_id) v ON s.item_id = v.item_id""", "parts_dense_pos", "parts_daily")


@register("training_summary", sql("""
SELECT status, count(*) AS parts, avg(mae) AS mean_mae, median(mae) AS median_mae, min(mae) AS min_mae,
       max(mae) AS max_mae, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100 AS pct_of_parts
FROM train_results GROUP BY status""", "train_results"))
def _training_summary(t):
    return E.training_summary(E.training_results_baseline(R.demand_parts(t, P), P, "MA_7"))
