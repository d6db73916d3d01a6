"""Extraction queries: header/line joins, filters and grouped sums.

All of them start from :func:`consumption_lines` (or its sales / purchase
siblings).  The join is an equi-join on ``txn_id``; the date predicate is on the
raw header timestamp so it is pushed into the parquet scan, and grouped sums use
Spark's partial (map-side) aggregation before the shuffle, so a part that owns a
third of all lines is spread over its (part, day) keys rather than one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partcast.functions.cols import ts_between_days
from partcast.params import Params
from partcast.sources.tables import Tables


def window_start(p: Params, days: int | None = None) -> dt.date:
    return p.as_of - dt.timedelta(days=p.days_back if days is None else days)


def consumption_lines(t: Tables, p: Params, start: dt.date | None = None,
                      end: dt.date | None = None, dirty: bool = False) -> DataFrame:
    """Job-order input lines (``in_out = 'I'``, not void) joined to their header.

    Columns: txn_id, item_id, stk_id, qty, txn_date, ds.
    """
    items = t.jo_item_dirty if dirty else t.jo_item
    i = items.where((F.col("in_out") == "I"))
    if p.void_scope == "both":
        i = i.where(F.col("void") == "0")
    h = t.jo_txn.where((F.col("void") == "0") & ts_between_days(F.col("txn_date"), start, end))
    return (i.select("txn_id", "item_id", "stk_id", "qty")
             .join(h.select("txn_id", "txn_date"), "txn_id")
             .withColumn("ds", F.to_date("txn_date")))


def daily_consumption(t: Tables, p: Params, start: dt.date | None = None,
                      end: dt.date | None = None) -> DataFrame:
    """Sparse daily sums (item_id, ds, qty) -- the input of every densifier."""
    return (consumption_lines(t, p, start, end)
            .groupBy("item_id", "ds").agg(F.sum("qty").alias("qty")))


def jo_consumption(t: Tables, p: Params) -> DataFrame:
    """Consumption per item, day and job over [as_of - days_back, as_of]."""
    return (consumption_lines(t, p, window_start(p), p.as_of)
            .groupBy("item_id", "ds", F.col("txn_id").alias("job_id"))
            .agg(F.coalesce(F.sum("qty"), F.lit(0.0)).alias("consumption")))


def sales_daily(t: Tables, p: Params) -> DataFrame:
    """Sales quantity per item, day and customer over the trailing window."""
    h = t.sorder_txn.where((F.col("void") == "0")
                           & ts_between_days(F.col("txn_date"), window_start(p), p.as_of))
    i = t.sorder_item.where(F.col("void") == "0")
    return (i.join(h, "txn_id")
             .groupBy("item_id", F.to_date("txn_date").alias("ds"), F.col("cust_id").alias("customer_id"))
             .agg(F.coalesce(F.sum("qty"), F.lit(0.0)).alias("quantity")))


def purchase_lines(t: Tables, p: Params) -> DataFrame:
    """Purchase quantity per item, order day, eta and supplier, with lead time."""
    h = t.porder_txn.where((F.col("void") == "0")
                           & ts_between_days(F.col("txn_date"), window_start(p), p.as_of))
    i = t.porder_item.where(F.col("void") == "0")
    return (i.join(h, "txn_id")
             .groupBy("item_id", F.to_date("txn_date").alias("order_date"), "eta_date",
                      F.col("supp_id").alias("supplier_id"))
             .agg(F.coalesce(F.sum("qty"), F.lit(0.0)).alias("quantity"))
             .withColumn("lead_time_days", F.datediff("eta_date", "order_date").cast("bigint")))


def parts_min_points(t: Tables, p: Params, start: dt.date | None = None) -> DataFrame:
    """Parts with at least ``min_points`` distinct demand days (full history to
    as_of by default), with total / mean line quantity and stock code."""
    lines = consumption_lines(t, p, start, p.as_of)
    stats = (lines.groupBy("item_id")
             .agg(F.countDistinct("ds").cast("bigint").alias("data_points"),
                  F.sum("qty").alias("total_consumption"),
                  F.avg("qty").alias("avg_consumption"))
             .where(F.col("data_points") >= p.min_points))
    # Aggregate first, then attach the master (one row per item) -- the join
    # sees one row per part instead of one per line.
    master = t.product_code.select("item_id", "stk_code")
    return (stats.join(master, "item_id", "left")
            .select(F.col("item_id").alias("part_id"), F.col("stk_code").alias("stock_code"),
                    "data_points", "total_consumption", "avg_consumption"))


def batch_parts(t: Tables, p: Params, parts: DataFrame | None = None) -> DataFrame:
    """Daily consumption restricted to a part list (left-semi join on the id)."""
    if parts is None:
        parts = parts_min_points(t, p).select(F.col("part_id").alias("item_id"))
    return (daily_consumption(t, p, None, p.as_of)
            .join(parts, "item_id", "left_semi")
            .select(F.col("item_id").alias("part_id"), F.col("ds"), F.col("qty").alias("consumption")))


def top_parts(t: Tables, p: Params, days: int = 90, n: int | None = None) -> DataFrame:
    """Top parts by consumption over the last ``days`` days."""
    n = n or p.top_n
    lines = consumption_lines(t, p, window_start(p, days), p.as_of)
    stats = (lines.groupBy("item_id")
             .agg(F.countDistinct("ds").cast("bigint").alias("active_days"),
                  F.sum("qty").alias("total_consumption"),
                  F.avg("qty").alias("avg_daily_consumption"),
                  F.min("qty").alias("min_consumption"),
                  F.max("qty").alias("max_consumption"),
                  F.stddev_pop("qty").alias("std_consumption")))
    top = stats.orderBy(F.desc("total_consumption"), F.asc("item_id")).limit(n)
    master = t.product_code.select("item_id", "stk_code", "prod_name")
    return (top.join(master, "item_id", "left")
            .select(F.col("item_id").alias("part_id"), F.col("stk_code").alias("stock_code"),
                    F.col("prod_name").alias("product_name"), "active_days", "total_consumption",
                    "avg_daily_consumption", "min_consumption", "max_consumption", "std_consumption"))


def product_lookup(t: Tables, p: Params) -> DataFrame:
    """Map every consumed item of the window to its live master row
    (DISTINCT item list left-joined to non-deleted master rows)."""
    items = consumption_lines(t, p, window_start(p), p.as_of).select("item_id").distinct()
    master = t.product_code.where(F.col("deleted") == "N").select("item_id", "stk_code", "prod_name")
    return items.join(master, "item_id", "left")


def stock_item_xref(t: Tables, p: Params, n: int | None = None) -> DataFrame:
    """Stock-id usage: lines, quantity, active days and distinct items per stock id (top n)."""
    n = n or p.top_n
    lines = consumption_lines(t, p, window_start(p), p.as_of)
    return (lines.groupBy("stk_id")
            .agg(F.count(F.lit(1)).alias("line_count"),
                 F.sum("qty").alias("total_consumption"),
                 F.countDistinct("ds").cast("bigint").alias("days_with_consumption"),
                 F.countDistinct("item_id").cast("bigint").alias("unique_itemids"))
            .orderBy(F.desc("total_consumption"), F.asc("stk_id")).limit(n))


def stock_item_pairs(t: Tables, p: Params) -> DataFrame:
    """Item id x stock id cross usage (lines and quantity per pair)."""
    lines = consumption_lines(t, p, window_start(p), p.as_of)
    return (lines.groupBy("item_id", "stk_id")
            .agg(F.count(F.lit(1)).alias("line_count"), F.sum("qty").alias("total_qty")))


def top_items_n(t: Tables, p: Params, n: int | None = None) -> DataFrame:
    """Top N items by total consumption in the window, with their share of the total.

    The grand total is a scalar subquery evaluated by Spark (no driver round
    trip, no join); the ranking window runs over at most ``n`` rows.
    """
    n = n or p.top_n
    per_item = (daily_consumption(t, p, window_start(p), p.as_of)
                .groupBy("item_id").agg(F.sum("qty").alias("total_consumption")))
    grand_total = per_item.agg(F.sum("total_consumption")).scalar()
    top = per_item.orderBy(F.desc("total_consumption"), F.asc("item_id")).limit(n)
    w = Window.orderBy(F.desc("total_consumption"), F.asc("item_id"))
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), "item_id", "total_consumption",
                      (F.col("total_consumption") / grand_total * 100).alias("pct_of_total"))


def top_part_series(t: Tables, p: Params, days: int = 90) -> DataFrame:
    """Arg-max part over the last ``days`` days, then its zero-filled daily series."""
    from partcast.operators.reshape import densify_own_span

    daily = daily_consumption(t, p, window_start(p, days), p.as_of)
    best = (daily.groupBy("item_id").agg(F.sum("qty").alias("total"))
            .orderBy(F.desc("total"), F.asc("item_id")).limit(1).select("item_id"))
    return densify_own_span(daily.join(best, "item_id", "left_semi"))


def recent_part(t: Tables, p: Params, days: int = 90) -> DataFrame:
    """Trailing ``days`` of every part, zero-filled between its first and last day."""
    from partcast.operators.reshape import densify_own_span

    return densify_own_span(daily_consumption(t, p, window_start(p, days), p.as_of))


def jo_series(t: Tables, p: Params) -> DataFrame:
    """Daily series per part over the trailing window, zero-filled (own span)."""
    from partcast.operators.reshape import densify_own_span

    return densify_own_span(daily_consumption(t, p, window_start(p), p.as_of))
