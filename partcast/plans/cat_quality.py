"""Registered queries: data quality and profiling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from partcast.operators import extract as X
from partcast.operators import quality as D
from partcast.operators import reshape as R
from partcast.plans.oracle_base import AS_OF, START, d
from partcast.plans.registry import P, register
from partcast.plans.sqlkit import cte, sql

FUTURE_AS_OF = dt.date(2001, 1, 1)   # FIXTURES: 1,299 orders are later than this
F_AS_OF = d(FUTURE_AS_OF)
D90 = d(P.as_of - dt.timedelta(days=90))

cte("dq_lines", """
SELECT i.*, t.txn_date, CAST(t.txn_date AS DATE) AS ds
FROM jo_item_dirty i JOIN jo_txn t ON i.txn_id = t.txn_id WHERE i.in_out = 'I' AND t.void = '0'""",
    "jo_item_dirty", "jo_txn")
cte("jo_cons", "SELECT item_id, ds, txn_id AS job_id, sum(qty) AS consumption FROM win_lines GROUP BY 1, 2, 3",
    "win_lines")


@register("dq_negative", sql("SELECT count_if(qty < 0) AS negative_quantities FROM dq_lines", "dq_lines"))
def _dq_negative(t):
    return D.dq_negative(t)


@register("dq_future", sql(f"""
SELECT count(*) AS future_dates FROM jo_txn WHERE void = '0' AND txn_date > {F_AS_OF}""", "jo_txn"))
def _dq_future(t):
    return D.dq_future(t, FUTURE_AS_OF)


@register("dq_orphan_items", sql("""
SELECT count(DISTINCT i.item_id) AS missing_product_codes FROM jo_item i
WHERE i.in_out = 'I' AND NOT EXISTS (SELECT 1 FROM product_code_with_gaps p WHERE p.item_id = i.item_id)""",
    "jo_item", "product_code_with_gaps"))
def _dq_orphan_items(t):
    return D.dq_orphan_items(t)


@register("dq_heavy_txn", sql(f"""
SELECT count(*) AS heavy_transactions FROM (
  SELECT txn_id FROM jo_item WHERE in_out = 'I' GROUP BY txn_id HAVING count(*) > {P.heavy_txn_lines}) x""",
    "jo_item"))
def _dq_heavy_txn(t):
    return D.dq_heavy_txn(t, P.heavy_txn_lines)


@register("dq_daily", sql(f"""
SELECT ds, count(DISTINCT item_id) AS unique_parts, count(*) AS transaction_count,
       count_if(qty < 0) AS negative_qty_count, count_if(qty = 0) AS zero_qty_count,
       count_if(txn_date > {AS_OF}) AS future_date_count
FROM dq_lines WHERE txn_date >= {D90} GROUP BY ds""", "dq_lines"))
def _dq_daily(t):
    return D.dq_daily(t, P.as_of, 90)


@register("dq_missing_dates", sql("""
SELECT CAST(g.ds AS DATE) AS missing_date
FROM (SELECT unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS ds FROM win_lines) g
WHERE CAST(g.ds AS DATE) NOT IN (SELECT ds FROM win_lines)""", "win_lines"))
def _dq_missing_dates(t):
    return D.dq_missing_dates(X.consumption_lines(t, P, X.window_start(P), P.as_of))


@register("dq_monthly_coverage", sql("""
SELECT strftime(txn_date, '%Y-%m') AS month, count(DISTINCT ds) AS active_days, count(DISTINCT item_id) AS unique_parts,
       count(*) AS transactions, sum(qty) AS total_consumption
FROM jo_lines GROUP BY 1 ORDER BY month DESC LIMIT 12""", "jo_lines"))
def _dq_monthly_coverage(t):
    return D.dq_monthly_coverage(t, 12)


def _range_sql(name: str, src: str, col: str) -> str:
    return f"""
SELECT '{name}' AS table_name, CAST(min({col}) AS DATE) AS min_date, CAST(max({col}) AS DATE) AS max_date,
       count(*) AS total_records, count(DISTINCT CAST({col} AS DATE)) AS unique_days,
       count_if(CAST({col} AS DATE) >= {D90}) AS recent_records
FROM {src} WHERE {col} IS NOT NULL"""


@register("dq_date_ranges", sql(f"""
SELECT *, CAST({AS_OF} - max_date AS BIGINT) AS days_since_last FROM (
{_range_sql('jo_txn', 'jo_txn', 'txn_date')}
UNION ALL {_range_sql('sorder_txn', 'sorder_txn', 'txn_date')}
UNION ALL {_range_sql('porder_txn', 'porder_txn', 'txn_date')}
UNION ALL {_range_sql('porder_item', 'porder_item', 'eta_date')}
UNION ALL {_range_sql('events', 'events', 'ts')}) u""", "jo_txn", "sorder_txn", "porder_txn", "porder_item"))
def _dq_date_ranges(t):
    return D.dq_date_ranges(t, P.as_of, 90)


@register("dq_consumption_range", sql("""
SELECT min(ds) AS min_date, max(ds) AS max_date, count(*) AS total_records, count(DISTINCT item_id) AS unique_parts,
       sum(qty) AS total_qty FROM jo_lines""", "jo_lines"))
def _dq_consumption_range(t):
    return D.dq_consumption_range(t)


@register("dq_inout_profile", sql("""
SELECT in_out, count(*) AS count, sum(qty) AS total_qty, min(qty) AS min_qty, max(qty) AS max_qty, avg(qty) AS avg_qty
FROM jo_item GROUP BY in_out""", "jo_item"))
def _dq_inout_profile(t):
    return D.dq_inout_profile(t)


@register("dq_void_profile", sql("""
SELECT i.void AS item_void, t.void AS txn_void, count(*) AS count
FROM jo_item i JOIN jo_txn t ON i.txn_id = t.txn_id GROUP BY 1, 2""", "jo_item", "jo_txn"))
def _dq_void_profile(t):
    return D.dq_void_profile(t)


@register("dq_latest_lines", sql("""
SELECT i.*, t.txn_date, t.doc_ref FROM jo_item i JOIN jo_txn t ON i.txn_id = t.txn_id
ORDER BY t.txn_date DESC, i.txn_id DESC, i.item_id, i.stk_id, i.qty, i.in_out, i.void LIMIT 10""",
    "jo_item", "jo_txn"))
def _dq_latest_lines(t):
    return D.dq_latest_lines(t, 10)


def _sources(t):
    return {
        "sales": X.sales_daily(t, P).select("item_id", "ds"),
        "purchases": X.purchase_lines(t, P).select("item_id", F.col("order_date").alias("ds")),
        "consumption": X.jo_consumption(t, P).select("item_id", "ds"),
    }


cte("dq_src", """
SELECT 'sales' AS source, item_id, ds FROM (SELECT item_id, ds, customer_id FROM sales_rows GROUP BY 1, 2, 3) s
UNION ALL
SELECT 'purchases', item_id, order_date FROM (SELECT item_id, order_date, eta_date, supplier_id FROM purchase_rows
                                              GROUP BY 1, 2, 3, 4) p
UNION ALL
SELECT 'consumption', item_id, ds FROM jo_cons""", "sales_rows", "purchase_rows", "jo_cons")


@register("dq_coverage_pct", sql("""
SELECT source, min(ds) AS date_min, max(ds) AS date_max, count(DISTINCT ds) AS days_with_data, count(*) AS records,
       CAST(max(ds) - min(ds) + 1 AS BIGINT) AS span_days,
       CAST(count(DISTINCT ds) AS DOUBLE) / (max(ds) - min(ds) + 1) * 100 AS coverage_pct,
       CAST(count(*) AS DOUBLE) / count(DISTINCT ds) AS records_per_day
FROM dq_src GROUP BY source""", "dq_src"))
def _dq_coverage_pct(t):
    return D.dq_coverage_pct(_sources(t))


@register("dq_weekend", sql("""
SELECT *, sum(CASE WHEN day_of_week >= 5 THEN records ELSE 0 END) OVER () AS weekend_records,
       avg(CASE WHEN day_of_week < 5 THEN records END) OVER () AS weekday_avg
FROM (SELECT isodow(ds) - 1 AS day_of_week, count(*) AS records FROM jo_cons GROUP BY 1) g""", "jo_cons"))
def _dq_weekend(t):
    return D.dq_weekend(X.jo_consumption(t, P))


@register("dq_sparse_items", sql("""
SELECT count_if(demand_days < (SELECT max(ds) - min(ds) + 1 FROM jo_cons) * 0.3) AS intermittent_items,
       count(*) AS total_items,
       CAST(count_if(demand_days < (SELECT max(ds) - min(ds) + 1 FROM jo_cons) * 0.3) AS DOUBLE) / count(*) * 100
         AS intermittent_pct
FROM (SELECT item_id, count(DISTINCT ds) AS demand_days FROM jo_cons GROUP BY item_id) g""", "jo_cons"))
def _dq_sparse_items(t):
    return D.dq_sparse_items(X.jo_consumption(t, P))


@register("dq_weekly_heatmap", sql(f"""
SELECT CAST(date_trunc('week', c.ds) + INTERVAL 6 DAY AS DATE) AS week_end, s.source,
       avg(CASE WHEN p.ds IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage
FROM (SELECT CAST(unnest(generate_series({START}, {AS_OF}, INTERVAL 1 DAY)) AS DATE) AS ds) c
CROSS JOIN (SELECT 'sales' AS source UNION ALL SELECT 'purchases' UNION ALL SELECT 'consumption') s
LEFT JOIN (SELECT DISTINCT source, ds FROM dq_src) p ON p.source = s.source AND p.ds = c.ds
GROUP BY 1, 2""", "dq_src"))
def _dq_weekly_heatmap(t):
    return D.dq_weekly_heatmap(_sources(t), X.window_start(P), P.as_of)


@register("dq_basic_stats", sql("""
SELECT avg(consumption) AS mean, stddev_samp(consumption) AS std, min(consumption) AS min, max(consumption) AS max,
       CAST(count_if(consumption = 0) AS DOUBLE) / count(*) * 100 AS zero_rows_pct,
       (SELECT avg(n) FROM (SELECT count(DISTINCT item_id) AS n FROM jo_cons GROUP BY ds) a) AS items_per_day_mean,
       (SELECT max(n) FROM (SELECT count(DISTINCT item_id) AS n FROM jo_cons GROUP BY ds) a) AS items_per_day_max,
       (SELECT min(n) FROM (SELECT count(DISTINCT item_id) AS n FROM jo_cons GROUP BY ds) a) AS items_per_day_min
FROM jo_cons""", "jo_cons"))
def _dq_basic_stats(t):
    return D.dq_basic_stats(X.jo_consumption(t, P))


@register("historical_summary", sql("""
SELECT item_id AS part_id, round_even(avg(qty), 2) AS consumption_mean, round_even(stddev_samp(qty), 2) AS consumption_std,
       round_even(min(qty), 2) AS consumption_min, round_even(max(qty), 2) AS consumption_max,
       count(*) AS consumption_count, min(ds) AS date_min, max(ds) AS date_max
FROM parts_dense GROUP BY item_id""", "parts_dense"))
def _historical_summary(t):
    return D.historical_summary(R.dense_series(t, P, "parts", "own"))
