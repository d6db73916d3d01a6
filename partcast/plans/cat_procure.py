"""Registered queries: procurement decisions and alerts.

The forecast feeding them is MA_NonZero fitted on each part's whole trailing
window and projected ``horizon`` days past as_of.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from partcast.operators import leadtime as L
from partcast.operators import procure as Q
from partcast.operators import reshape as R
from partcast.operators.extract import recent_part, window_start
from partcast.plans import cat_forecast  # noqa: F401  (forecast CTEs)
from partcast.plans import cat_leadtime  # noqa: F401  (lead-time CTEs)
from partcast.plans.oracle_base import AS_OF, d
from partcast.plans.registry import P, register
from partcast.plans.sqlkit import cte, sql

URGENT = d(P.as_of + dt.timedelta(days=P.urgent_days))
WARN = d(P.as_of + dt.timedelta(days=P.warning_days))
WARN_ORDER = d(P.as_of + dt.timedelta(days=P.warning_days - 2))
REC_DATE = d(P.as_of + dt.timedelta(days=7))
SF = P.safety_factor

cte("fut", f"""
SELECT item_id, h, CAST(train_end + CAST(h AS INTEGER) AS DATE) AS ds, MA_NonZero AS predicted_demand
FROM fut_const, generate_series(1, {P.horizon}) AS g(h)""", "fut_const")
cte("fut_ss", f"""
SELECT item_id, h, ds, round_even(predicted_demand, 0) AS predicted_demand,
       round_even(predicted_demand * {SF!r}, 0) AS safety_stock FROM fut""", "fut")
cte("fut_part_urgency", """
SELECT f.item_id, f.next_7_days, hm.avg_consumption,
       CASE WHEN f.total = 0 THEN 'normal' WHEN hm.avg_consumption IS NULL THEN 'normal'
            WHEN f.next_7_days > hm.avg_consumption * 10 THEN 'critical'
            WHEN f.next_7_days > hm.avg_consumption * 7 THEN 'high'
            WHEN f.next_7_days > hm.avg_consumption * 5 THEN 'medium' ELSE 'normal' END AS urgency
FROM (SELECT item_id, sum(CASE WHEN h <= 7 THEN predicted_demand END) AS next_7_days,
             sum(predicted_demand) AS total FROM fut GROUP BY item_id) f
LEFT JOIN (SELECT item_id, avg(qty) AS avg_consumption FROM p90_dense GROUP BY item_id) hm
  ON f.item_id = hm.item_id""", "fut", "p90_dense")
cte("fut_rec", f"""
SELECT item_id, CASE WHEN sum(predicted_demand) <> 0 THEN {REC_DATE} END AS recommended_order_date,
       CASE WHEN sum(predicted_demand) <> 0
            THEN sum(CASE WHEN h <= {P.horizon} THEN predicted_demand END) * {SF!r} END AS recommended_order_quantity
FROM fut GROUP BY item_id""", "fut")


def _fut(t):
    return Q.future_forecast(R.demand_parts(t, P), P, "MA_NonZero", window_start(P), P.as_of)


def _ss(t):
    return Q.safety_stock(_fut(t), P.safety_factor)


@register("safety_stock", sql("SELECT * FROM fut_ss", "fut_ss"))
def _safety_stock(t):
    return _ss(t)


@register("urgent_orders", sql(f"""
SELECT item_id, sum(predicted_demand) AS total_demand, max(safety_stock) AS safety_stock,
       {AS_OF} AS order_by_date, 'URGENT' AS priority
FROM fut_ss WHERE ds <= {URGENT} GROUP BY item_id HAVING sum(predicted_demand) > 0""", "fut_ss"))
def _urgent_orders(t):
    return Q.urgent_orders(_ss(t), P.as_of, P.urgent_days)


@register("warning_orders", sql(f"""
SELECT item_id, sum(predicted_demand) AS total_demand, max(safety_stock) AS safety_stock,
       {WARN_ORDER} AS order_by_date, 'WARNING' AS priority
FROM fut_ss WHERE ds > {URGENT} AND ds <= {WARN} GROUP BY item_id HAVING sum(predicted_demand) > 0""", "fut_ss"))
def _warning_orders(t):
    return Q.warning_orders(_ss(t), P.as_of, P.urgent_days, P.warning_days)


@register("procurement_summary", sql(f"""
SELECT i.total_items, i.total_predicted_demand, i.items_with_demand, d.avg_daily_demand, d.peak_demand_date,
       {P.horizon} AS forecast_horizon
FROM (SELECT count(*) AS total_items, sum(t) AS total_predicted_demand, count_if(t > 0) AS items_with_demand
      FROM (SELECT item_id, sum(predicted_demand) AS t FROM fut_ss GROUP BY item_id) x) i,
     (SELECT avg(day_total) AS avg_daily_demand, arg_min(ds, (-day_total, ds)) AS peak_demand_date
      FROM (SELECT ds, sum(predicted_demand) AS day_total FROM fut_ss GROUP BY ds) y) d""", "fut_ss"))
def _procurement_summary(t):
    return Q.procurement_summary(_ss(t), P.horizon)


@register("row_urgency", sql(f"""
SELECT *, CAST(ds - {AS_OF} AS BIGINT) AS days_ahead,
       CASE WHEN ds - {AS_OF} <= {P.urgent_days} THEN 'critical' WHEN ds - {AS_OF} <= {P.warning_days} THEN 'warning'
            ELSE 'normal' END AS urgency
FROM fut_ss""", "fut_ss"))
def _row_urgency(t):
    return Q.row_urgency(_ss(t), P.as_of, P.urgent_days, P.warning_days)


@register("part_urgency", sql("SELECT * FROM fut_part_urgency", "fut_part_urgency"))
def _part_urgency(t):
    return Q.part_urgency(_fut(t), recent_part(t, P))


@register("order_recommendation", sql("SELECT * FROM fut_rec", "fut_rec"))
def _order_recommendation(t):
    return Q.order_recommendation(_fut(t), P.as_of, P.safety_factor, 7, P.horizon)


@register("confidence_band", sql("""
SELECT *, greatest(0.0, predicted_demand * 0.8) AS lower_bound, predicted_demand * 1.2 AS upper_bound FROM fut""",
    "fut"))
def _confidence_band(t):
    return Q.confidence_band(_fut(t))


@register("alerts", sql("""
SELECT u.item_id, m.stk_code AS stock_code, u.urgency,
       'Part ' || COALESCE(m.stk_code, CAST(u.item_id AS VARCHAR)) || ' needs attention' AS message,
       r.recommended_order_date AS predicted_stockout_date,
       CASE WHEN r.recommended_order_quantity IS NOT NULL AND r.recommended_order_quantity <> 0
            THEN 'Order ' || CAST(CAST(round_even(r.recommended_order_quantity, 0) AS BIGINT) AS VARCHAR)
                 || ' units by ' || strftime(r.recommended_order_date, '%Y-%m-%d')
            ELSE 'Review inventory' END AS recommended_action,
       f.current_consumption_rate, f.days_until_stockout
FROM (SELECT item_id, urgency FROM fut_part_urgency WHERE urgency IN ('critical', 'high')) u
JOIN (SELECT item_id, min(CASE WHEN predicted_demand > 0 THEN h END) AS days_until_stockout,
             avg(predicted_demand) AS current_consumption_rate FROM fut GROUP BY item_id) f ON u.item_id = f.item_id
LEFT JOIN fut_rec r ON u.item_id = r.item_id
LEFT JOIN product_code m ON u.item_id = m.item_id""", "fut_part_urgency", "fut", "fut_rec", "product_code"))
def _alerts(t):
    return Q.alerts(_fut(t), recent_part(t, P), t.product_code, P.as_of, P.safety_factor, 7, P.horizon)


@register("critical_order_dates", sql(f"""
SELECT f.item_id AS part_id, m.stk_code AS stock_code, f.ds AS date_needed,
       round_even(f.predicted_demand, 0) AS forecast_qty,
       round_even(greatest(0.0, f.predicted_demand * 0.8), 0) AS min_qty,
       round_even(f.predicted_demand * 1.2, 0) AS max_qty,
       COALESCE(CAST(round_even(l.lead_time_median_all_suppliers, 0) AS INTEGER), {P.default_lead_time})
         AS lead_time_days,
       CAST(f.ds - COALESCE(CAST(round_even(l.lead_time_median_all_suppliers, 0) AS INTEGER),
                            {P.default_lead_time}) AS DATE) AS order_by
FROM fut f LEFT JOIN lt_items l ON f.item_id = l.item_id LEFT JOIN product_code m ON f.item_id = m.item_id
WHERE f.ds - {AS_OF} <= {P.urgent_days}""", "fut", "lt_items", "product_code"))
def _critical_order_dates(t):
    lead = L.item_lead_stats(L.lead_time_stats(L.lead_times(t.purchases, P.on_time_tolerance)))
    return Q.critical_order_dates(_fut(t), P.as_of, lead, t.product_code, P.default_lead_time)


@register("batch_predict_status", sql("""
SELECT q.part_id, CASE WHEN h.item_id IS NOT NULL THEN 'success' ELSE 'failed' END AS status,
       count_if(h.item_id IS NOT NULL) OVER () AS successful, count_if(h.item_id IS NULL) OVER () AS failed,
       count(*) OVER () AS total_parts
FROM (SELECT item_id AS part_id FROM product_code WHERE deleted = 'N') q
LEFT JOIN (SELECT DISTINCT item_id FROM fut) h ON q.part_id = h.item_id""", "product_code", "fut"))
def _batch_predict_status(t):
    req = t.product_code.where(F.col("deleted") == "N").select(F.col("item_id").alias("part_id"))
    return Q.batch_predict_status(req, _fut(t))
