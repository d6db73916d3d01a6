"""Registered queries: lead-time and supplier analytics."""

from __future__ import annotations

from partcast.operators import leadtime as L
from partcast.operators import reshape as R
from partcast.operators.extract import top_items_n
from partcast.plans.oracle_base import AS_OF
from partcast.plans.registry import P, register
from partcast.plans.sqlkit import cte, sql


def lt_sql(src: str) -> str:
    return f"""
SELECT item_id, order_date, eta_date, actual_receive_date, supplier_id, quantity,
       promised_lead_days, actual_lead_days, actual_lead_days - promised_lead_days AS delivery_delay,
       abs(actual_lead_days - promised_lead_days) <= {P.on_time_tolerance} AS on_time
FROM (SELECT *, CAST(eta_date - order_date AS INTEGER) AS promised_lead_days,
             CAST(COALESCE(actual_receive_date - order_date, eta_date - order_date) AS INTEGER) AS actual_lead_days
      FROM {src}) x
WHERE promised_lead_days > 0 AND promised_lead_days < 365"""


def stats_sql(src: str) -> str:
    return f"""
SELECT item_id, supplier_id, avg(a) AS lead_time_mean, quantile_cont(a, 0.5) AS lead_time_median,
       stddev_samp(a) AS lead_time_std, min(a) AS lead_time_min, max(a) AS lead_time_max,
       quantile_cont(a, 0.25) AS lead_time_p25, quantile_cont(a, 0.75) AS lead_time_p75,
       quantile_cont(a, 0.95) AS lead_time_p95, avg(CAST(on_time AS DOUBLE)) AS supplier_reliability,
       count(*) AS order_count,
       CASE WHEN avg(a) > 0 THEN stddev_samp(a) / avg(a) ELSE 0.0 END AS lead_time_cv
FROM (SELECT *, CAST(actual_lead_days AS DOUBLE) AS a FROM {src}
      WHERE item_id IS NOT NULL AND supplier_id IS NOT NULL) x
GROUP BY item_id, supplier_id HAVING count(*) >= 2"""


cte("lt", lt_sql("purchases"), "purchases")
cte("lt_stats", stats_sql("lt"), "lt")
cte("lt_items", """
SELECT item_id, avg(lead_time_mean) AS lead_time_mean_all_suppliers,
       quantile_cont(lead_time_median, 0.5) AS lead_time_median_all_suppliers,
       avg(lead_time_std) AS lead_time_std_all_suppliers, min(lead_time_min) AS lead_time_min_all_suppliers,
       max(lead_time_max) AS lead_time_max_all_suppliers, max(lead_time_p95) AS lead_time_p95_all_suppliers,
       avg(supplier_reliability) AS supplier_reliability_all_suppliers,
       avg(lead_time_cv) AS lead_time_cv_all_suppliers, sum(order_count) AS order_count_all_suppliers
FROM lt_stats GROUP BY item_id""", "lt_stats")


def item_features_sql(src: str) -> str:
    return f"""
SELECT *, lead_time_p95_all_suppliers - lead_time_mean_all_suppliers AS lead_time_buffer_days,
       lead_time_max_all_suppliers - lead_time_min_all_suppliers AS lead_time_range,
       CASE WHEN order_count_all_suppliers > 0 THEN 1 ELSE 0 END AS has_purchase_history,
       lead_time_p95_all_suppliers + 3 AS reorder_horizon
FROM (SELECT d.*, COALESCE(s.lead_time_mean_all_suppliers, 14.0) AS lead_time_mean_all_suppliers,
             COALESCE(s.lead_time_median_all_suppliers, 14.0) AS lead_time_median_all_suppliers,
             COALESCE(s.lead_time_std_all_suppliers, 0.0) AS lead_time_std_all_suppliers,
             COALESCE(s.lead_time_min_all_suppliers, 7.0) AS lead_time_min_all_suppliers,
             COALESCE(s.lead_time_max_all_suppliers, 14.0) AS lead_time_max_all_suppliers,
             COALESCE(s.lead_time_p95_all_suppliers, 14.0) AS lead_time_p95_all_suppliers,
             COALESCE(s.supplier_reliability_all_suppliers, 0.8) AS supplier_reliability_all_suppliers,
             COALESCE(s.lead_time_cv_all_suppliers, 0.0) AS lead_time_cv_all_suppliers,
             COALESCE(s.order_count_all_suppliers, 0) AS order_count_all_suppliers
      FROM {src} d LEFT JOIN lt_items s ON d.item_id = s.item_id) x"""


cte("pw", f"SELECT * FROM purchases WHERE order_date <= {AS_OF}", "purchases")
cte("pw_restricted", "SELECT * FROM pw WHERE item_id IN (SELECT item_id FROM top_item_ids)", "pw", "top_item_ids")
cte("pw_most", "SELECT item_id FROM pw GROUP BY item_id ORDER BY count(*) DESC, item_id LIMIT 20", "pw")
cte("pw_chosen", """
SELECT * FROM pw_restricted
UNION ALL
SELECT * FROM pw WHERE item_id IN (SELECT item_id FROM pw_most) AND NOT EXISTS (SELECT 1 FROM pw_restricted)""",
    "pw_restricted", "pw_most", "pw")
cte("lt_chosen", lt_sql("pw_chosen"), "pw_chosen")
cte("lt_chosen_stats", stats_sql("lt_chosen"), "lt_chosen")


def _lt(t):
    return L.lead_times(t.purchases, P.on_time_tolerance)


def _stats(t):
    return L.lead_time_stats(_lt(t))


@register("lead_times", sql("SELECT * FROM lt", "lt"))
def _lead_times(t):
    return _lt(t)


@register("lead_time_stats", sql("SELECT * FROM lt_stats", "lt_stats"))
def _lead_time_stats(t):
    return _stats(t)


@register("lead_time_item_features", sql(item_features_sql("parts_dense"), "parts_dense", "lt_items"))
def _lead_time_item_features(t):
    return L.lead_time_item_features(R.dense_series(t, P, "parts", "own"), _stats(t))


def _dyn_sql() -> str:
    cols = []
    ref = AS_OF
    for w in (30, 60, 90, 180):
        inside = f"order_date >= {ref} - {w}"
        slope = f"regr_slope(CASE WHEN {inside} THEN a END, CASE WHEN {inside} THEN x END)"
        cols += [f"avg(CASE WHEN {inside} THEN a END) AS lead_time_mean_{w}d",
                 f"stddev_samp(CASE WHEN {inside} THEN a END) AS lead_time_std_{w}d",
                 f"COALESCE(CASE WHEN isnan({slope}) THEN NULL ELSE {slope} END, 0.0) AS lead_time_trend_{w}d",
                 f"sum(CASE WHEN {inside} THEN 1 ELSE 0 END) AS order_count_{w}d"]
    return f"""
SELECT item_id, {', '.join(cols)}
FROM (SELECT *, CAST(actual_lead_days AS DOUBLE) AS a,
             CAST(order_date - DATE '1970-01-01' AS DOUBLE) AS x FROM lt WHERE item_id IS NOT NULL) y
GROUP BY item_id"""


@register("lead_time_dynamic", sql(_dyn_sql(), "lt"))
def _lead_time_dynamic(t):
    return L.lead_time_dynamic(_lt(t), P.as_of)


@register("procurement_urgency", sql(f"""
SELECT item_id, lead_time_p95_all_suppliers, required_order_lead_days,
       CASE WHEN required_order_lead_days <= 0 THEN NULL WHEN required_order_lead_days <= 7 THEN 'immediate'
            WHEN required_order_lead_days <= 14 THEN 'urgent' WHEN required_order_lead_days <= 30 THEN 'normal'
            ELSE 'low' END AS order_urgency,
       CASE WHEN required_order_lead_days <= 7 THEN 1 ELSE 0 END AS needs_immediate_order,
       CASE WHEN required_order_lead_days <= 14 THEN 1 ELSE 0 END AS needs_urgent_order
FROM (SELECT *, lead_time_p95_all_suppliers + {P.default_lead_time} AS required_order_lead_days
      FROM ({item_features_sql("(SELECT DISTINCT item_id FROM parts_dense)")}) f) g""",
    "parts_dense", "lt_items"))
def _procurement_urgency(t):
    items = R.dense_series(t, P, "parts", "own").select("item_id").distinct()
    f = L.procurement_urgency(L.lead_time_item_features(items, _stats(t)), P.default_lead_time)
    return f.select("item_id", "lead_time_p95_all_suppliers", "required_order_lead_days", "order_urgency",
                    "needs_immediate_order", "needs_urgent_order")


cte("supplier_scores", """
SELECT *, CASE WHEN performance_score IS NOT NULL THEN
            CAST(rank() OVER (PARTITION BY performance_score IS NOT NULL ORDER BY performance_score DESC) AS DOUBLE)
            + (count(*) OVER (PARTITION BY performance_score IS NOT NULL, performance_score) - 1) / 2.0
          END AS supplier_rank
FROM (SELECT * EXCLUDE (raw), CASE WHEN raw IS NOT NULL THEN least(greatest(raw, 0.0), 100.0) END AS performance_score
      FROM (SELECT *, on_time_rate * 50 + (1.0 - lead_time_std / greatest(avg_lead_time, 1.0)) * 30
                      + (1.0 - greatest(avg_delay, 0.0) / greatest(avg_lead_time, 1.0)) * 20 AS raw
      FROM (SELECT supplier_id, avg(CAST(actual_lead_days AS DOUBLE)) AS avg_lead_time,
                   stddev_samp(CAST(actual_lead_days AS DOUBLE)) AS lead_time_std,
                   min(CAST(actual_lead_days AS DOUBLE)) AS min_lead_time,
                   max(CAST(actual_lead_days AS DOUBLE)) AS max_lead_time,
                   avg(CAST(delivery_delay AS DOUBLE)) AS avg_delay,
                   stddev_samp(CAST(delivery_delay AS DOUBLE)) AS delay_std,
                   avg(CAST(on_time AS DOUBLE)) AS on_time_rate, count(order_date) AS total_orders
            FROM lt WHERE supplier_id IS NOT NULL GROUP BY supplier_id) s) r) p""", "lt")


@register("supplier_performance", sql("SELECT * FROM supplier_scores", "supplier_scores"))
def _supplier_performance(t):
    return L.supplier_performance(_lt(t))


@register("supplier_top", sql("""
SELECT * FROM supplier_scores WHERE performance_score IS NOT NULL ORDER BY round(performance_score, 9) DESC, supplier_id LIMIT 5""",
    "supplier_scores"))
def _supplier_top(t):
    return L.supplier_top(L.supplier_performance(_lt(t)))


@register("lead_time_trending", sql(f"""
SELECT item_id, lead_time_trend_180d, CASE WHEN lead_time_trend_180d > 0 THEN 'increasing' ELSE 'decreasing' END AS direction
FROM ({_dyn_sql()}) d WHERE abs(lead_time_trend_180d) > 0.1""", "lt"))
def _lead_time_trending(t):
    return L.trending_items(L.lead_time_dynamic(_lt(t), P.as_of))


@register("lead_time_top", sql("""
SELECT * FROM lt_chosen_stats ORDER BY order_count DESC, item_id, supplier_id LIMIT 10""", "lt_chosen_stats"))
def _lead_time_top(t):
    purchases = L.purchases_in_window(t.purchases, None, P.as_of)
    return L.lead_time_top(purchases, top_items_n(t, P))
