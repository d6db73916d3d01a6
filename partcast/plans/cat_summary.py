"""Registered queries: summary analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from partcast.operators import classify as K
from partcast.operators import evaluate as E
from partcast.operators import extract as X
from partcast.operators import leadtime as L
from partcast.operators import procure as Q
from partcast.operators import reshape as R
from partcast.operators import summary as S
from partcast.operators.extract import window_start
from partcast.plans import cat_evaluate, cat_procure  # noqa: F401  (CTEs)
from partcast.plans.cat_evaluate import CLASSIC, _ev
from partcast.plans.registry import P, register
from partcast.plans.sqlkit import cte, sql


def _results(t):
    return E.training_results_baseline(R.demand_parts(t, P), P, "MA_7")


def _fut(t):
    return Q.future_forecast(R.demand_parts(t, P), P, "MA_NonZero", window_start(P), P.as_of)


def _urgency(t):
    return Q.part_urgency(_fut(t), X.recent_part(t, P))


@register("analytics_summary", sql("""
SELECT count(*) AS total_parts_monitored,
       CASE WHEN avg(mae) < 1 THEN 1.0 - avg(mae) ELSE 0.95 END AS average_model_accuracy,
       COALESCE((SELECT count_if(urgency = 'critical') FROM fut_part_urgency
                 WHERE urgency IN ('critical', 'high')), 0) AS critical_alerts,
       COALESCE((SELECT string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY o, item_id) FROM (
          SELECT item_id, CASE WHEN urgency = 'critical' THEN 0 ELSE 1 END AS o FROM fut_part_urgency
          WHERE urgency IN ('critical', 'high') ORDER BY o, item_id LIMIT 10) h), '') AS high_risk_parts,
       count_if(zero_pct > 90) AS high_intermittency
FROM train_results WHERE status = 'success'""", "train_results", "fut_part_urgency"))
def _analytics_summary(t):
    return S.analytics_summary(_results(t), _urgency(t))


@register("model_status", sql("""
SELECT part_id, CASE WHEN zero_pct > 80 THEN 'TwoStage' ELSE 'XGBoost' END AS model_type, mae, zero_pct
FROM train_results WHERE status = 'success'""", "train_results"))
def _model_status(t):
    return S.model_status(_results(t))


@register("results_overview", sql("""
SELECT 'training' AS section, m.metric, CAST(NULL AS VARCHAR) AS detail, m.value FROM (
  SELECT unnest(['total_parts', 'success_rate', 'average_mae', 'best_mae', 'average_zero_pct']) AS metric,
         unnest([CAST(count(*) AS DOUBLE), avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END), avg(mae),
                 min(mae), avg(zero_pct)]) AS value FROM train_results) m
UNION ALL
SELECT 'best_models', 'rank_' || CAST(row_number() OVER (ORDER BY round(mae, 9), part_id) AS VARCHAR),
       CAST(part_id AS VARCHAR), mae
FROM (SELECT * FROM train_results WHERE mae IS NOT NULL ORDER BY round(mae, 9), part_id LIMIT 5) b
UNION ALL
SELECT 'suppliers', m.metric, NULL, m.value FROM (
  SELECT unnest(['suppliers', 'average_lead_time', 'average_on_time_rate']) AS metric,
         unnest([CAST(count(*) AS DOUBLE), avg(avg_lead_time), avg(on_time_rate)]) AS value
  FROM (SELECT supplier_id, avg(CAST(actual_lead_days AS DOUBLE)) AS avg_lead_time,
               avg(CAST(on_time AS DOUBLE)) AS on_time_rate FROM lt WHERE supplier_id IS NOT NULL
        GROUP BY supplier_id) s) m
UNION ALL
SELECT 'lead_time', m.metric, NULL, m.value FROM (
  SELECT unnest(['item_supplier_pairs', 'average_lead_time', 'average_p95', 'average_reliability']) AS metric,
         unnest([CAST(count(*) AS DOUBLE), avg(lead_time_mean), avg(lead_time_p95), avg(supplier_reliability)])
           AS value FROM lt_stats) m
UNION ALL
SELECT 'coverage', m.metric, NULL, m.value FROM (
  SELECT unnest(['parts', 'very_high_intermittency', 'high_intermittency', 'moderate_intermittency']) AS metric,
         unnest([CAST(count(*) AS DOUBLE), count_if(zero_pct > 90), count_if(zero_pct >= 70 AND zero_pct <= 90),
                 count_if(zero_pct < 70)]) AS value FROM parts_zero_pct) m""",
    "train_results", "lt", "lt_stats", "parts_zero_pct"))
def _results_overview(t):
    lt = L.lead_times(t.purchases, P.on_time_tolerance)
    return S.results_overview(_results(t), L.supplier_performance(lt), L.lead_time_stats(lt),
                              K.zero_percentage(R.demand_parts(t, P)))


cte("cmp", """
SELECT c.item_id, c.mae AS candidate_mae, b.best_mae AS baseline_mae,
       (b.best_mae - c.mae) * 100 / nullif(b.best_mae, 0.0) AS improvement_pct
FROM (SELECT item_id, mae FROM fc_metrics WHERE method = 'TSB') c JOIN best_classic b ON c.item_id = b.item_id""",
    "fc_metrics", "best_classic")


@register("pipeline_summary", sql("""
SELECT 'summary' AS kind, CAST(NULL AS VARCHAR) AS item_id, avg(candidate_mae) AS candidate_mae,
       avg(baseline_mae) AS baseline_mae, avg(improvement_pct) AS improvement_pct,
       max(improvement_pct) AS max_improvement, min(improvement_pct) AS min_improvement FROM cmp
UNION ALL
SELECT * FROM (SELECT 'best', CAST(item_id AS VARCHAR), candidate_mae, baseline_mae, improvement_pct, NULL, NULL FROM cmp
               WHERE improvement_pct IS NOT NULL ORDER BY improvement_pct DESC, item_id LIMIT 3) b
UNION ALL
SELECT * FROM (SELECT 'worst', CAST(item_id AS VARCHAR), candidate_mae, baseline_mae, improvement_pct, NULL, NULL FROM cmp
               WHERE improvement_pct IS NOT NULL ORDER BY improvement_pct ASC, item_id LIMIT 3) w""", "cmp"))
def _pipeline_summary(t):
    m = E.error_metrics(_ev(t))
    cmp = E.compare_vs_baseline(m.where(F.col("method") == "TSB"), m.where(F.col("method").isin(*CLASSIC)))
    return S.pipeline_summary(cmp)


@register("report_summary", sql("""
SELECT f.item_id, f.forecast_sum, f.forecast_mean, u.urgency, r.zero_pct, r.mae
FROM (SELECT item_id, sum(predicted_demand) AS forecast_sum, avg(predicted_demand) AS forecast_mean
      FROM fut GROUP BY item_id) f
LEFT JOIN fut_part_urgency u ON f.item_id = u.item_id
LEFT JOIN train_results r ON f.item_id = r.part_id""", "fut", "fut_part_urgency", "train_results"))
def _report_summary(t):
    return S.report_summary(_fut(t), _urgency(t), _results(t))


@register("forecast_summary", sql(f"""
SELECT count(DISTINCT ds) AS horizon_days, count(DISTINCT item_id) AS total_parts,
       count_if(ds - DATE '{P.as_of.isoformat()}' <= {P.urgent_days}) AS critical_orders,
       count_if(ds - DATE '{P.as_of.isoformat()}' > {P.urgent_days}
                AND ds - DATE '{P.as_of.isoformat()}' <= {P.warning_days}) AS warning_orders
FROM fut""", "fut"))
def _forecast_summary(t):
    return S.forecast_summary(Q.row_urgency(_fut(t), P.as_of, P.urgent_days, P.warning_days))


@register("daily_total", sql("SELECT ds, sum(consumption) AS total_consumption FROM jo_cons GROUP BY ds", "jo_cons"))
def _daily_total(t):
    return S.daily_total(X.jo_consumption(t, P))
