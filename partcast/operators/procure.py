"""Procurement decisions and alerts.

Input is a long forecast table (item_id, ds, predicted_demand) -- one row per
item and future day -- so every decision is a filter + grouped aggregate over
item-partitioned rows; nothing loops over parts on the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def future_forecast(series: DataFrame, p, method: str = "MA_NonZero", start: dt.date | None = None,
                    end: dt.date | None = None) -> DataFrame:
    """Fit ``method`` on the whole series (dense, or sparse daily sums with the
    span given by ``start`` / ``end``) and forecast the next ``p.horizon`` days:
    (item_id, h, ds, predicted_demand)."""
    from partcast.operators.baselines import forecast_constants, to_long

    consts = forecast_constants(series, p.ses_alpha, p.croston_alpha, 0, start, end)
    return to_long(consts, (method,), p.horizon).select(
        "item_id", "h", "ds", F.col("yhat").alias("predicted_demand"))


def safety_stock(fc: DataFrame, factor: float = 1.2) -> DataFrame:
    """safety = predicted x factor taken before rounding; both rounded half-even."""
    return fc.withColumns({
        "safety_stock": F.bround(F.col("predicted_demand") * factor, 0),
        "predicted_demand": F.bround(F.col("predicted_demand"), 0),
    })


def _orders(fc: DataFrame, cond, order_by: dt.date, priority: str) -> DataFrame:
    return (fc.where(cond).groupBy("item_id")
            .agg(F.sum("predicted_demand").alias("total_demand"), F.max("safety_stock").alias("safety_stock"))
            .where(F.col("total_demand") > 0)
            .withColumns({"order_by_date": F.lit(order_by), "priority": F.lit(priority)}))


def urgent_orders(fc: DataFrame, as_of: dt.date, urgent_days: int = 2) -> DataFrame:
    """Items with demand due on or before as_of + urgent_days: order today."""
    return _orders(fc, F.col("ds") <= F.lit(as_of + dt.timedelta(days=urgent_days)), as_of, "URGENT")


def warning_orders(fc: DataFrame, as_of: dt.date, urgent_days: int = 2, warning_days: int = 7) -> DataFrame:
    """Demand due in (as_of + urgent_days, as_of + warning_days]: order by as_of + warning - 2."""
    lo = F.lit(as_of + dt.timedelta(days=urgent_days))
    hi = F.lit(as_of + dt.timedelta(days=warning_days))
    return _orders(fc, (F.col("ds") > lo) & (F.col("ds") <= hi),
                   as_of + dt.timedelta(days=warning_days - 2), "WARNING")


def procurement_summary(fc: DataFrame, horizon: int) -> DataFrame:
    """Items, horizon, total demand, mean daily total, peak day (earliest on
    ties) and items with any demand; the per-day figures are scalar subqueries."""
    daily = fc.groupBy("ds").agg(F.sum("predicted_demand").alias("day_total"))
    per_item = fc.groupBy("item_id").agg(F.sum("predicted_demand").alias("item_total"))
    i = per_item.agg(F.count(F.lit(1)).alias("total_items"), F.sum("item_total").alias("total_predicted_demand"),
                     F.sum(F.when(F.col("item_total") > 0, 1).otherwise(0)).cast("bigint").alias("items_with_demand"))
    return i.withColumns({
        "avg_daily_demand": daily.agg(F.avg("day_total")).scalar(),
        "peak_demand_date": daily.agg(F.min_by("ds", F.struct(-F.col("day_total"), F.col("ds")))).scalar(),
        "forecast_horizon": F.lit(horizon),
    })


def row_urgency(fc: DataFrame, as_of: dt.date, urgent_days: int = 2, warning_days: int = 7) -> DataFrame:
    ahead = F.datediff("ds", F.lit(as_of))
    return fc.withColumns({"days_ahead": ahead,
                           "urgency": F.when(ahead <= urgent_days, "critical")
                           .when(ahead <= warning_days, "warning").otherwise("normal")})


def part_urgency(fc: DataFrame, history: DataFrame) -> DataFrame:
    """Next-7-day forecast vs 10x / 7x / 5x the item's mean daily history ->
    critical / high / medium; normal otherwise (or without forecast demand)."""
    f = fc.groupBy("item_id").agg(
        F.sum(F.when(F.col("h") <= 7, F.col("predicted_demand"))).alias("next_7_days"),
        F.sum("predicted_demand").alias("_total"))
    hmean = history.groupBy("item_id").agg(F.avg("qty").alias("avg_consumption"))
    j = f.join(hmean, "item_id", "left")
    n7, avg = F.col("next_7_days"), F.col("avg_consumption")
    level = (F.when(F.col("_total") == 0, "normal").when(avg.isNull(), "normal")
             .when(n7 > avg * 10, "critical").when(n7 > avg * 7, "high").when(n7 > avg * 5, "medium")
             .otherwise("normal"))
    return j.withColumn("urgency", level).drop("_total")


def order_recommendation(fc: DataFrame, as_of: dt.date, factor: float = 1.2, lead_days: int = 7,
                         horizon: int = 14) -> DataFrame:
    """qty = factor x first ``horizon`` days of forecast, date = as_of + lead_days;
    both NULL when the item has no forecast demand."""
    g = fc.groupBy("item_id").agg(F.sum(F.when(F.col("h") <= horizon, F.col("predicted_demand"))).alias("_t"),
                                  F.sum("predicted_demand").alias("_all"))
    has = F.col("_all") != 0
    return g.select("item_id",
                    F.when(has, F.lit(as_of + dt.timedelta(days=lead_days))).alias("recommended_order_date"),
                    F.when(has, F.col("_t") * factor).alias("recommended_order_quantity"))


def confidence_band(fc: DataFrame, low: float = 0.8, high: float = 1.2) -> DataFrame:
    p = F.col("predicted_demand")
    return fc.withColumns({"lower_bound": F.greatest(F.lit(0.0), p * low), "upper_bound": p * high})


def alerts(fc: DataFrame, history: DataFrame, master: DataFrame, as_of: dt.date, factor: float = 1.2,
           lead_days: int = 7, horizon: int = 14, levels=("critical", "high")) -> DataFrame:
    """Critical / high parts with first day of positive demand, message, action
    and mean daily rate; sorted critical first.  Urgency, recommendation and the
    alert fields come out of one aggregation of the forecast rows."""
    p = F.col("predicted_demand")
    f = fc.groupBy("item_id").agg(
        F.sum(F.when(F.col("h") <= 7, p)).alias("next_7_days"),
        F.sum(p).alias("_total"),
        F.sum(F.when(F.col("h") <= horizon, p)).alias("_t"),
        F.min(F.when(p > 0, F.col("h"))).alias("days_until_stockout"),
        F.avg(p).alias("current_consumption_rate"))
    hmean = history.groupBy("item_id").agg(F.avg("qty").alias("avg_consumption"))
    n7, avg = F.col("next_7_days"), F.col("avg_consumption")
    level = (F.when(F.col("_total") == 0, "normal").when(avg.isNull(), "normal")
             .when(n7 > avg * 10, "critical").when(n7 > avg * 7, "high").when(n7 > avg * 5, "medium")
             .otherwise("normal"))
    has = F.col("_total") != 0
    j = (f.join(hmean, "item_id", "left")
         .withColumns({"urgency": level,
                       "recommended_order_date": F.when(has, F.lit(as_of + dt.timedelta(days=lead_days))),
                       "recommended_order_quantity": F.when(has, F.col("_t") * factor)})
         .where(F.col("urgency").isin(*levels))
         .join(master.select("item_id", F.col("stk_code").alias("stock_code")), "item_id", "left"))
    label = F.coalesce(F.col("stock_code"), F.col("item_id").cast("string"))
    qty = F.col("recommended_order_quantity")
    action = F.when(qty.isNotNull() & (qty != 0),
                    F.concat(F.lit("Order "), F.bround(qty, 0).cast("bigint").cast("string"), F.lit(" units by "),
                             F.date_format("recommended_order_date", "yyyy-MM-dd"))) \
        .otherwise(F.lit("Review inventory"))
    out = j.select("item_id", "stock_code", "urgency",
                   F.concat(F.lit("Part "), label, F.lit(" needs attention")).alias("message"),
                   F.col("recommended_order_date").alias("predicted_stockout_date"),
                   action.alias("recommended_action"), "current_consumption_rate", "days_until_stockout")
    rank = F.when(F.col("urgency") == "critical", 0).otherwise(1)
    return out.orderBy(rank, "item_id")


def critical_order_dates(fc: DataFrame, as_of: dt.date, lead: DataFrame, master: DataFrame,
                         default_lead: int = 7) -> DataFrame:
    """Critical forecast rows with order-by = date - lead time (item median lead
    time when known, else ``default_lead``), sorted by date then forecast desc."""
    rows = confidence_band(row_urgency(fc, as_of)).where(F.col("urgency") == "critical")
    lt = lead.select("item_id", F.bround("lead_time_median_all_suppliers", 0).cast("int").alias("_lt"))
    j = (rows.join(lt, "item_id", "left")
         .join(master.select("item_id", F.col("stk_code").alias("stock_code")), "item_id", "left"))
    lt_days = F.coalesce(F.col("_lt"), F.lit(default_lead))
    return (j.select(F.col("item_id").alias("part_id"), "stock_code", F.col("ds").alias("date_needed"),
                     F.bround("predicted_demand", 0).alias("forecast_qty"),
                     F.bround("lower_bound", 0).alias("min_qty"), F.bround("upper_bound", 0).alias("max_qty"),
                     lt_days.alias("lead_time_days"), F.date_sub("ds", lt_days).alias("order_by"))
            .orderBy("date_needed", F.desc("forecast_qty"), "part_id"))


def batch_predict_status(requested: DataFrame, fc: DataFrame) -> DataFrame:
    """Every requested part (part_id): it succeeds when it has forecast rows.  Per part
    status plus the success / failure counts, which one combined aggregate adds."""
    have = fc.select("item_id").distinct().withColumn("_ok", F.lit(True))
    j = requested.join(have, requested.part_id == have.item_id, "left")
    per = j.select("part_id", F.when(F.col("_ok"), "success").otherwise("failed").alias("status"))
    ok = F.sum(F.when(F.col("status") == "success", 1).otherwise(0)).cast("bigint")
    totals = per.agg(ok.alias("successful"), (F.count(F.lit(1)) - ok).alias("failed"), F.count(F.lit(1)).alias("total_parts"))
    return per.withColumns({c: totals.select(c).scalar() for c in ("successful", "failed", "total_parts")})
