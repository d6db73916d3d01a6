"""Data-quality checks and profiles.

All are grouped aggregates, anti joins or set differences over the source
tables.  Calendars (missing dates, weekly coverage) are generated from the
observed min / max dates with ``sequence`` -- bounded by the calendar span,
never by the data volume.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partcast.functions.cols import count_if, ts_between_days
from partcast.sources.tables import Tables


def _lines(t: Tables, dirty: bool = True, line_void: bool = False) -> DataFrame:
    """Input lines joined to a non-void header (header-only void test, as the checks do)."""
    i = (t.jo_item_dirty if dirty else t.jo_item).where(F.col("in_out") == "I")
    if line_void:
        i = i.where(F.col("void") == "0")
    h = t.jo_txn.where(F.col("void") == "0").select("txn_id", "txn_date")
    return i.join(h, "txn_id").withColumn("ds", F.to_date("txn_date"))


def dq_negative(t: Tables) -> DataFrame:
    return _lines(t).agg(count_if(F.col("qty") < 0).alias("negative_quantities"))


def dq_future(t: Tables, as_of: dt.date) -> DataFrame:
    h = t.jo_txn.where((F.col("void") == "0") & (F.col("txn_date") > F.lit(as_of)))
    return h.agg(F.count(F.lit(1)).alias("future_dates"))


def dq_orphan_items(t: Tables) -> DataFrame:
    items = t.jo_item.where(F.col("in_out") == "I").select("item_id")
    orphans = items.join(t.product_code_with_gaps.select("item_id"), "item_id", "left_anti")
    return orphans.agg(F.countDistinct("item_id").cast("bigint").alias("missing_product_codes"))


def dq_heavy_txn(t: Tables, limit: int) -> DataFrame:
    per = (t.jo_item.where(F.col("in_out") == "I").groupBy("txn_id").agg(F.count(F.lit(1)).alias("cnt"))
           .where(F.col("cnt") > limit))
    return per.agg(F.count(F.lit(1)).alias("heavy_transactions"))


def dq_daily(t: Tables, as_of: dt.date, days: int = 90) -> DataFrame:
    start = as_of - dt.timedelta(days=days)
    lines = _lines(t).where(ts_between_days(F.col("txn_date"), start, None))
    return lines.groupBy("ds").agg(
        F.countDistinct("item_id").cast("bigint").alias("unique_parts"),
        F.count(F.lit(1)).alias("transaction_count"),
        count_if(F.col("qty") < 0).alias("negative_qty_count"),
        count_if(F.col("qty") == 0).alias("zero_qty_count"),
        count_if(F.col("txn_date") > F.lit(as_of)).alias("future_date_count"))


def dq_missing_dates(days: DataFrame) -> DataFrame:
    """Calendar days between the first and last observed day that have no rows."""
    span = days.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    cal = span.select(F.explode(F.sequence("lo", "hi")).alias("ds"))
    return cal.join(days.select("ds").distinct(), "ds", "left_anti").withColumnRenamed("ds", "missing_date")


def dq_monthly_coverage(t: Tables, months: int = 12) -> DataFrame:
    lines = _lines(t, dirty=False, line_void=True)
    g = lines.groupBy(F.date_format("txn_date", "yyyy-MM").alias("month")).agg(
        F.countDistinct("ds").cast("bigint").alias("active_days"),
        F.countDistinct("item_id").cast("bigint").alias("unique_parts"),
        F.count(F.lit(1)).alias("transactions"), F.sum("qty").alias("total_consumption"))
    return g.orderBy(F.desc("month")).limit(months)


def dq_date_ranges(t: Tables, as_of: dt.date, days: int = 90) -> DataFrame:
    """min / max / rows / unique days per dated table, rows in the last ``days``
    days and days since the last record."""
    recent_start = as_of - dt.timedelta(days=days)
    specs = [("jo_txn", t.jo_txn, "txn_date"), ("sorder_txn", t.sorder_txn, "txn_date"),
             ("porder_txn", t.porder_txn, "txn_date"), ("porder_item", t.porder_item, "eta_date"),
             ("events", t.events, "ts")]
    out = None
    for name, df, col in specs:
        c = F.col(col)
        g = df.where(c.isNotNull()).agg(
            F.to_date(F.min(c)).alias("min_date"), F.to_date(F.max(c)).alias("max_date"),
            F.count(F.lit(1)).alias("total_records"),
            F.countDistinct(F.to_date(c)).cast("bigint").alias("unique_days"),
            count_if(F.to_date(c) >= F.lit(recent_start)).alias("recent_records"),
        ).select(F.lit(name).alias("table_name"), "*")
        out = g if out is None else out.unionByName(g)
    return out.withColumn("days_since_last", F.datediff(F.lit(as_of), "max_date"))


def dq_consumption_range(t: Tables) -> DataFrame:
    lines = _lines(t, dirty=False, line_void=True)
    return lines.agg(F.min("ds").alias("min_date"), F.max("ds").alias("max_date"),
                     F.count(F.lit(1)).alias("total_records"),
                     F.countDistinct("item_id").cast("bigint").alias("unique_parts"),
                     F.sum("qty").alias("total_qty"))


def dq_inout_profile(t: Tables) -> DataFrame:
    q = F.col("qty")
    return t.jo_item.groupBy("in_out").agg(F.count(F.lit(1)).alias("count"), F.sum(q).alias("total_qty"),
                                           F.min(q).alias("min_qty"), F.max(q).alias("max_qty"),
                                           F.avg(q).alias("avg_qty"))


def dq_void_profile(t: Tables) -> DataFrame:
    i = t.jo_item.select("txn_id", F.col("void").alias("item_void"))
    h = t.jo_txn.select("txn_id", F.col("void").alias("txn_void"))
    return i.join(h, "txn_id").groupBy("item_void", "txn_void").agg(F.count(F.lit(1)).alias("count"))


def dq_latest_lines(t: Tables, n: int = 10) -> DataFrame:
    """Latest ``n`` joined lines (ties broken on every output column)."""
    j = t.jo_item.join(t.jo_txn.select("txn_id", "txn_date", "doc_ref"), "txn_id")
    return j.orderBy(F.desc("txn_date"), F.desc("txn_id"), "item_id", "stk_id", "qty", "in_out", "void").limit(n)


def dq_coverage_pct(sources: dict[str, DataFrame]) -> DataFrame:
    """Per source of (ds, ...) rows: span, days with data, coverage % and rows per active day."""
    out = None
    for name, df in sources.items():
        g = df.agg(F.min("ds").alias("date_min"), F.max("ds").alias("date_max"),
                   F.countDistinct("ds").cast("bigint").alias("days_with_data"),
                   F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("source"), "*")
        out = g if out is None else out.unionByName(g)
    span = (F.datediff("date_max", "date_min") + 1).cast("bigint")
    return out.withColumns({"span_days": span,
                            "coverage_pct": F.col("days_with_data") / span * 100,
                            "records_per_day": F.col("records") / F.col("days_with_data")})


def dq_weekend(rows: DataFrame) -> DataFrame:
    """Records per day of week (Monday = 0) with the weekend total and weekday mean."""
    per = rows.groupBy(F.weekday("ds").alias("day_of_week")).agg(F.count(F.lit(1)).alias("records"))
    w = Window.partitionBy()
    return per.withColumns({
        "weekend_records": F.sum(F.when(F.col("day_of_week") >= 5, F.col("records")).otherwise(0)).over(w),
        "weekday_avg": F.avg(F.when(F.col("day_of_week") < 5, F.col("records"))).over(w),
    })


def dq_sparse_items(rows: DataFrame, share: float = 0.3) -> DataFrame:
    """Items with demand on fewer than ``share`` of the days in the overall span."""
    span = rows.agg((F.datediff(F.max("ds"), F.min("ds")) + 1).alias("total_days"))
    per = rows.groupBy("item_id").agg(F.countDistinct("ds").alias("demand_days"))
    total = span.select("total_days").scalar()
    flagged = count_if(F.col("demand_days") < total * share)
    return per.agg(flagged.alias("intermittent_items"), F.count(F.lit(1)).alias("total_items")).withColumn(
        "intermittent_pct", F.col("intermittent_items") / F.col("total_items") * 100)


def dq_weekly_heatmap(sources: dict[str, DataFrame], start: dt.date, end: dt.date) -> DataFrame:
    """0/1 presence per day and source over [start, end], averaged per week
    (weeks end on Sunday; the label is that Sunday)."""
    cal = (F.sequence(F.lit(start), F.lit(end)))
    out = None
    for name, df in sources.items():
        present = df.select("ds").distinct().withColumn("_p", F.lit(1.0))
        days = df.sparkSession.range(1).select(F.explode(cal).alias("ds"))
        g = (days.join(present, "ds", "left")
             .select(F.date_add(F.date_trunc("week", "ds").cast("date"), 6).alias("week_end"),
                     F.coalesce("_p", F.lit(0.0)).alias("_p"))
             .groupBy("week_end").agg(F.avg("_p").alias("coverage"))
             .select("week_end", F.lit(name).alias("source"), "coverage"))
        out = g if out is None else out.unionByName(g)
    return out


def dq_basic_stats(rows: DataFrame, value: str = "consumption") -> DataFrame:
    v = F.col(value)
    per_day = rows.groupBy("ds").agg(F.countDistinct("item_id").alias("items"))
    s = rows.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
                 F.max(v).alias("max"), (count_if(v == 0) / F.count(F.lit(1)) * 100).alias("zero_rows_pct"))
    # per-day figures come in as scalar subqueries (one row each, no join)
    return s.withColumns({
        "items_per_day_mean": per_day.agg(F.avg("items")).scalar(),
        "items_per_day_max": per_day.agg(F.max("items").cast("bigint")).scalar(),
        "items_per_day_min": per_day.agg(F.min("items").cast("bigint")).scalar(),
    })


def historical_summary(series: DataFrame) -> DataFrame:
    q = F.col("qty")
    return series.groupBy(F.col("item_id").alias("part_id")).agg(
        F.bround(F.avg(q), 2).alias("consumption_mean"), F.bround(F.stddev_samp(q), 2).alias("consumption_std"),
        F.bround(F.min(q), 2).alias("consumption_min"), F.bround(F.max(q), 2).alias("consumption_max"),
        F.count(F.lit(1)).alias("consumption_count"),
        F.min("ds").alias("date_min"), F.max("ds").alias("date_max"))
