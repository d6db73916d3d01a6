"""Oracle CTE library: the fixture mapping and demand series in DuckDB SQL.

These mirror ``partcast.sources.tables`` and ``partcast.operators.reshape``
for the default parameters (as_of 2001-08-01, 365-day window; events as_of
2024-01-30, 30-day window).
"""

from __future__ import annotations

import datetime as dt

from partcast.plans.registry import EP, P
from partcast.plans.sqlkit import cte


def d(x: dt.date) -> str:
    return f"DATE '{x.isoformat()}'"


AS_OF = d(P.as_of)
START = d(P.as_of - dt.timedelta(days=P.days_back))
START90 = d(P.as_of - dt.timedelta(days=90))
EV_AS_OF = d(EP.as_of)
EV_START = d(EP.as_of - dt.timedelta(days=EP.days_back))

cte("jo_txn", """
SELECT o_orderkey AS txn_id, o_orderdate AS txn_date, o_orderpriority AS doc_ref,
       CASE WHEN o_orderstatus = 'P' THEN '1' ELSE '0' END AS void
FROM orders""")
cte("jo_item", """
SELECT l_orderkey AS txn_id, l_partkey AS item_id, l_suppkey AS stk_id, l_quantity AS qty,
       CASE WHEN l_linestatus = 'O' THEN 'I' ELSE 'O' END AS in_out,
       CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS void
FROM lineitem""")
cte("jo_item_dirty", """
SELECT l_orderkey AS txn_id, l_partkey AS item_id, l_suppkey AS stk_id,
       CASE WHEN l_linenumber = 7 THEN -l_quantity WHEN l_linenumber = 6 THEN 0.0 ELSE l_quantity END AS qty,
       CASE WHEN l_linestatus = 'O' THEN 'I' ELSE 'O' END AS in_out,
       CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS void
FROM lineitem""")
cte("sorder_txn", """
SELECT o_orderkey AS txn_id, o_orderdate AS txn_date, o_custkey AS cust_id,
       CASE WHEN o_orderstatus = 'P' THEN '1' ELSE '0' END AS void
FROM orders""")
cte("sorder_item", """
SELECT l_orderkey AS txn_id, l_partkey AS item_id, l_quantity AS qty,
       CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS void
FROM lineitem""")
cte("porder_txn", "SELECT o_orderkey AS txn_id, o_orderdate AS txn_date, '0' AS void FROM orders")
cte("porder_item", """
SELECT l_orderkey AS txn_id, l_partkey AS item_id, l_suppkey AS supp_id, l_quantity AS qty,
       CAST(l_shipdate AS DATE) AS eta_date, l_linenumber AS line_no, '0' AS void
FROM lineitem""")
cte("purchases", """
SELECT i.item_id, CAST(t.txn_date AS DATE) AS order_date, i.eta_date,
       i.eta_date + (i.line_no - 4) AS actual_receive_date,
       i.supp_id AS supplier_id, i.qty AS quantity
FROM porder_item i JOIN porder_txn t ON i.txn_id = t.txn_id""", "porder_item", "porder_txn")
cte("product_code", """
SELECT p_partkey AS item_id, p_partkey AS stk_id, p_brand AS stk_code, p_name AS prod_name,
       CASE WHEN p_partkey % 17 = 0 THEN 'Y' ELSE 'N' END AS deleted
FROM part""")
cte("product_code_with_gaps", "SELECT * FROM product_code WHERE item_id % 10 <> 3", "product_code")

# consumption lines (in_out = 'I', header and line not void), all dates
cte("jo_lines", """
SELECT i.txn_id, i.item_id, i.stk_id, i.qty, t.txn_date, CAST(t.txn_date AS DATE) AS ds
FROM jo_item i JOIN jo_txn t ON i.txn_id = t.txn_id
WHERE i.in_out = 'I' AND i.void = '0' AND t.void = '0'""", "jo_item", "jo_txn")
cte("jo_lines_dirty", """
SELECT i.txn_id, i.item_id, i.stk_id, i.qty, t.txn_date, CAST(t.txn_date AS DATE) AS ds
FROM jo_item_dirty i JOIN jo_txn t ON i.txn_id = t.txn_id
WHERE i.in_out = 'I' AND i.void = '0' AND t.void = '0'""", "jo_item_dirty", "jo_txn")
cte("win_lines", f"SELECT * FROM jo_lines WHERE ds BETWEEN {START} AND {AS_OF}", "jo_lines")
cte("win90_lines", f"SELECT * FROM jo_lines WHERE ds BETWEEN {START90} AND {AS_OF}", "jo_lines")
cte("hist_lines", f"SELECT * FROM jo_lines WHERE ds <= {AS_OF}", "jo_lines")


def own_span(name: str, daily: str) -> None:
    """Register ``{name}`` = zero-filled own-span series of CTE ``daily``."""
    cte(f"{name}_span", f"SELECT item_id, min(ds) AS mn, max(ds) AS mx FROM {daily} GROUP BY item_id", daily)
    cte(f"{name}_grid", f"""
SELECT item_id, CAST(unnest(generate_series(mn, mx, INTERVAL 1 DAY)) AS DATE) AS ds FROM {name}_span""",
        f"{name}_span")
    cte(name, f"""
SELECT g.item_id, g.ds, COALESCE(x.qty, 0.0) AS qty
FROM {name}_grid g LEFT JOIN {daily} x ON g.item_id = x.item_id AND g.ds = x.ds""", f"{name}_grid", daily)


def fixed_window(name: str, daily: str, start: str, end: str) -> None:
    """Register ``{name}`` = every item of ``daily`` on the [start, end] calendar."""
    cte(f"{name}_grid", f"""
SELECT i.item_id, CAST(g.ds AS DATE) AS ds
FROM (SELECT DISTINCT item_id FROM {daily} WHERE ds BETWEEN {start} AND {end}) i,
     (SELECT unnest(generate_series({start}, {end}, INTERVAL 1 DAY)) AS ds) g""", daily)
    cte(name, f"""
SELECT g.item_id, g.ds, COALESCE(x.qty, 0.0) AS qty
FROM {name}_grid g LEFT JOIN {daily} x ON g.item_id = x.item_id AND g.ds = x.ds""", f"{name}_grid", daily)


cte("parts_daily", "SELECT item_id, ds, sum(qty) AS qty FROM win_lines GROUP BY item_id, ds", "win_lines")
cte("family_daily", "SELECT item_id % 200 AS item_id, ds, sum(qty) AS qty FROM win_lines GROUP BY 1, 2",
    "win_lines")
cte("events_all_daily", f"""
SELECT user_id AS item_id, CAST(ts AS DATE) AS ds, sum(value) AS qty FROM events
WHERE user_id IS NOT NULL AND CAST(ts AS DATE) BETWEEN {EV_START} AND {EV_AS_OF} GROUP BY 1, 2""")
cte("events_purchase_daily", f"""
SELECT user_id AS item_id, CAST(ts AS DATE) AS ds, sum(value) AS qty FROM events
WHERE user_id IS NOT NULL AND event_type = 'purchase'
  AND CAST(ts AS DATE) BETWEEN {EV_START} AND {EV_AS_OF} GROUP BY 1, 2""")
for _src in ("parts", "family", "events_all", "events_purchase"):
    own_span(f"{_src}_dense", f"{_src}_daily")
fixed_window("parts_fixed", "parts_daily", START, AS_OF)
fixed_window("family_fixed", "family_daily", START, AS_OF)
fixed_window("events_all_fixed", "events_all_daily", EV_START, EV_AS_OF)
fixed_window("events_purchase_fixed", "events_purchase_daily", EV_START, EV_AS_OF)

# dense series with position columns (rn 0-based, n = length)
for _name in ("parts_dense", "family_dense", "events_all_dense", "events_purchase_dense",
              "parts_fixed", "family_fixed", "events_all_fixed", "events_purchase_fixed"):
    cte(f"{_name}_pos", f"""
SELECT item_id, ds, qty,
       CAST(row_number() OVER (PARTITION BY item_id ORDER BY ds) - 1 AS INTEGER) AS rn,
       CAST(count(*) OVER (PARTITION BY item_id) AS INTEGER) AS n
FROM {_name}""", _name)
