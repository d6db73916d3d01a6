"""Registered queries: extraction."""

from __future__ import annotations

from partcast.operators import extract as X
from partcast.plans.oracle_base import AS_OF, START, own_span
from partcast.plans.registry import P, register
from partcast.plans.sqlkit import cte, sql

cte("p90_daily", "SELECT item_id, ds, sum(qty) AS qty FROM win90_lines GROUP BY item_id, ds", "win90_lines")
own_span("p90_dense", "p90_daily")
cte("sales_rows", f"""
SELECT i.item_id, CAST(t.txn_date AS DATE) AS ds, t.cust_id AS customer_id, i.qty
FROM sorder_item i JOIN sorder_txn t ON i.txn_id = t.txn_id
WHERE t.void = '0' AND i.void = '0' AND CAST(t.txn_date AS DATE) BETWEEN {START} AND {AS_OF}""",
    "sorder_item", "sorder_txn")
cte("purchase_rows", f"""
SELECT i.item_id, CAST(t.txn_date AS DATE) AS order_date, i.eta_date, i.supp_id AS supplier_id, i.qty
FROM porder_item i JOIN porder_txn t ON i.txn_id = t.txn_id
WHERE t.void = '0' AND i.void = '0' AND CAST(t.txn_date AS DATE) BETWEEN {START} AND {AS_OF}""",
    "porder_item", "porder_txn")
cte("eligible_parts", f"""
SELECT item_id FROM hist_lines GROUP BY item_id HAVING count(DISTINCT ds) >= {P.min_points}""", "hist_lines")


@register("jo_consumption", sql("""
SELECT item_id, ds, txn_id AS job_id, COALESCE(sum(qty), 0.0) AS consumption
FROM win_lines GROUP BY item_id, ds, txn_id""", "win_lines"))
def _jo_consumption(t):
    return X.jo_consumption(t, P)


@register("jo_series", sql("SELECT item_id, ds, qty FROM parts_dense", "parts_dense"))
def _jo_series(t):
    return X.jo_series(t, P)


@register("sales_daily", sql("""
SELECT item_id, ds, customer_id, COALESCE(sum(qty), 0.0) AS quantity
FROM sales_rows GROUP BY item_id, ds, customer_id""", "sales_rows"))
def _sales_daily(t):
    return X.sales_daily(t, P)


@register("purchase_lines", sql("""
SELECT item_id, order_date, eta_date, supplier_id, quantity,
       CAST(eta_date - order_date AS BIGINT) AS lead_time_days
FROM (SELECT item_id, order_date, eta_date, supplier_id, COALESCE(sum(qty), 0.0) AS quantity
      FROM purchase_rows GROUP BY item_id, order_date, eta_date, supplier_id) g""", "purchase_rows"))
def _purchase_lines(t):
    return X.purchase_lines(t, P)


@register("parts_min_points", sql(f"""
SELECT s.item_id AS part_id, pc.stk_code AS stock_code, s.data_points, s.total_consumption, s.avg_consumption
FROM (SELECT item_id, count(DISTINCT ds) AS data_points, sum(qty) AS total_consumption,
             avg(qty) AS avg_consumption
      FROM hist_lines GROUP BY item_id HAVING count(DISTINCT ds) >= {P.min_points}) s
LEFT JOIN product_code pc ON s.item_id = pc.item_id""", "hist_lines", "product_code"))
def _parts_min_points(t):
    return X.parts_min_points(t, P)


@register("batch_parts", sql("""
SELECT item_id AS part_id, ds, sum(qty) AS consumption FROM hist_lines
WHERE item_id IN (SELECT item_id FROM eligible_parts) GROUP BY item_id, ds""", "hist_lines", "eligible_parts"))
def _batch_parts(t):
    return X.batch_parts(t, P)


@register("recent_part", sql("SELECT item_id, ds, qty FROM p90_dense", "p90_dense"))
def _recent_part(t):
    return X.recent_part(t, P)


@register("top_parts", sql("""
SELECT s.item_id AS part_id, pc.stk_code AS stock_code, pc.prod_name AS product_name, s.active_days,
       s.total_consumption, s.avg_daily_consumption, s.min_consumption, s.max_consumption, s.std_consumption
FROM (SELECT item_id, count(DISTINCT ds) AS active_days, sum(qty) AS total_consumption,
             avg(qty) AS avg_daily_consumption, min(qty) AS min_consumption, max(qty) AS max_consumption,
             stddev_pop(qty) AS std_consumption
      FROM win90_lines GROUP BY item_id ORDER BY total_consumption DESC, item_id LIMIT 20) s
LEFT JOIN product_code pc ON s.item_id = pc.item_id""", "win90_lines", "product_code"))
def _top_parts(t):
    return X.top_parts(t, P)


@register("top_part_series", sql("""
SELECT item_id, ds, qty FROM p90_dense
WHERE item_id = (SELECT item_id FROM p90_daily GROUP BY item_id ORDER BY sum(qty) DESC, item_id LIMIT 1)""",
    "p90_dense", "p90_daily"))
def _top_part_series(t):
    return X.top_part_series(t, P)


@register("product_lookup", sql("""
SELECT i.item_id, m.stk_code, m.prod_name
FROM (SELECT DISTINCT item_id FROM win_lines) i
LEFT JOIN (SELECT item_id, stk_code, prod_name FROM product_code WHERE deleted = 'N') m
       ON i.item_id = m.item_id""", "win_lines", "product_code"))
def _product_lookup(t):
    return X.product_lookup(t, P)


@register("stock_item_pairs", sql("""
SELECT item_id, stk_id, count(*) AS line_count, sum(qty) AS total_qty FROM win_lines GROUP BY item_id, stk_id""", "win_lines"))
def _stock_item_pairs(t):
    return X.stock_item_pairs(t, P)


@register("stock_item_xref", sql("""
SELECT stk_id, count(*) AS line_count, sum(qty) AS total_consumption,
       count(DISTINCT ds) AS days_with_consumption, count(DISTINCT item_id) AS unique_itemids
FROM win_lines GROUP BY stk_id ORDER BY total_consumption DESC, stk_id LIMIT 20""", "win_lines"))
def _stock_item_xref(t):
    return X.stock_item_xref(t, P)


@register("top_items_n", sql("""
SELECT row_number() OVER (ORDER BY total_consumption DESC, item_id) AS rank, item_id, total_consumption,
       total_consumption / (SELECT sum(qty) FROM parts_daily) * 100 AS pct_of_total
FROM (SELECT item_id, sum(qty) AS total_consumption FROM parts_daily GROUP BY item_id
      ORDER BY total_consumption DESC, item_id LIMIT 20) s""", "parts_daily"))
def _top_items_n(t):
    return X.top_items_n(t, P)
