"""Registered queries: densification, splits and reshaping."""

from __future__ import annotations

from partcast.operators import reshape as R
from partcast.plans.oracle_base import AS_OF, START, fixed_window
from partcast.plans.registry import P, register
from partcast.plans.sqlkit import cte, sql

cte("top_item_ids", f"""
SELECT item_id FROM parts_daily GROUP BY item_id ORDER BY sum(qty) DESC, item_id LIMIT {P.top_n}""",
    "parts_daily")
cte("top_daily", "SELECT * FROM parts_daily WHERE item_id IN (SELECT item_id FROM top_item_ids)",
    "parts_daily", "top_item_ids")
fixed_window("top_fixed", "top_daily", START, AS_OF)
cte("sales_d", "SELECT item_id, ds, sum(qty) AS sales_qty FROM sales_rows GROUP BY item_id, ds", "sales_rows")


@register("densify_own_span", sql("SELECT item_id, ds, qty FROM parts_dense", "parts_dense"))
def _densify_own_span(t):
    return R.dense_series(t, P, "parts", "own")


@register("densify_fixed_window", sql("SELECT item_id, ds, qty FROM parts_fixed", "parts_fixed"))
def _densify_fixed_window(t):
    return R.dense_series(t, P, "parts", "fixed")


@register("aggregate_demand", sql("""
SELECT g.ds, g.item_id, COALESCE(s.sales_qty, 0.0) AS sales_qty,
       COALESCE(c.qty, 0.0) AS consumption_qty,
       COALESCE(s.sales_qty, 0.0) + COALESCE(c.qty, 0.0) AS total_demand
FROM (SELECT i.item_id, CAST(unnest(generate_series(b.lo, b.hi, INTERVAL 1 DAY)) AS DATE) AS ds
      FROM (SELECT item_id FROM sales_d UNION SELECT item_id FROM parts_daily
            UNION SELECT item_id FROM purchase_rows) i,
           (SELECT min(ds) AS lo, max(ds) AS hi
            FROM (SELECT ds FROM sales_d UNION ALL SELECT ds FROM parts_daily) u) b) g
LEFT JOIN sales_d s ON g.item_id = s.item_id AND g.ds = s.ds
LEFT JOIN parts_daily c ON g.item_id = c.item_id AND g.ds = c.ds""",
    "sales_d", "parts_daily", "purchase_rows"))
def _aggregate_demand(t):
    return R.aggregate_demand(t, P)


@register("series_union_dates", sql("""
SELECT min(ds) AS min_date, max(ds) AS max_date, count(*) AS n_dates
FROM (SELECT ds FROM sales_rows UNION SELECT ds FROM parts_daily) u""", "sales_rows", "parts_daily"))
def _series_union_dates(t):
    return R.series_union_dates(t, P)


cte("top_ranks", f"""
SELECT item_id, row_number() OVER (ORDER BY sum(qty) DESC, item_id) AS rank FROM parts_daily GROUP BY item_id
QUALIFY rank <= {P.top_n}""", "parts_daily")


@register("pivot_top", sql("SELECT ds, " + ", ".join(
    f"coalesce(sum(CASE WHEN rank = {k} THEN qty END), 0.0) AS top_{k:02d}" for k in range(1, P.top_n + 1))
    + " FROM top_fixed JOIN top_ranks USING (item_id) GROUP BY ds", "top_fixed", "top_ranks"))
def _pivot_top(t):
    return R.pivot_top(t, P)


@register("split_holdout", sql(f"""
SELECT item_id, ds, qty, CASE WHEN rn >= n - {P.horizon} THEN 'test' ELSE 'train' END AS split
FROM parts_dense_pos WHERE n - {P.horizon} >= {P.min_train}""", "parts_dense_pos"))
def _split_holdout(t):
    return R.split_holdout(R.dense_series(t, P, "parts", "own"), P.horizon, P.min_train)


@register("split_80_20", sql(f"""
SELECT item_id, ds, qty,
       CASE WHEN n < {P.min_train} THEN 'insufficient_data'
            WHEN rn < floor(n * 0.8) THEN 'train' ELSE 'validation' END AS split
FROM parts_dense_pos""", "parts_dense_pos"))
def _split_80_20(t):
    return R.split_80_20(R.dense_series(t, P, "parts", "own"), P.min_train)
