"""Demand sources, calendar densification, splits and reshaping.

Series are kept *long* -- one row per (item_id, ds) -- and hash-partitioned by
``item_id``.  Densification needs no join: each observed day is exploded into
itself plus the empty days up to the next observed day (``lead`` over an
item-partitioned window), so the output stays partitioned by ``item_id`` and
every later per-item window reuses that partitioning without another exchange.
A dense series is at most ``days_back + 1`` rows per item, whatever the raw
line skew (raw lines are pre-aggregated to one row per item and day first).
The observed days are many times smaller than the days filled in, so they are
spread over all shuffle partitions before (``spread``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partcast.functions.windows import by_item

from partcast.operators.extract import daily_consumption, window_start
from partcast.params import Params
from partcast.sources.tables import Tables


# -- demand sources --------------------------------------------------------------------
def demand_parts(t: Tables, p: Params) -> DataFrame:
    """Sparse daily consumption per part in the trailing window."""
    return daily_consumption(t, p, window_start(p), p.as_of)


def demand_family(t: Tables, p: Params, families: int = 200) -> DataFrame:
    """Sparse daily consumption per part family (``part_id % families``)."""
    from partcast.operators.extract import consumption_lines

    lines = consumption_lines(t, p, window_start(p), p.as_of)
    return (lines.groupBy((F.col("item_id") % families).alias("item_id"), "ds")
            .agg(F.sum("qty").alias("qty")))


def demand_total(t: Tables, p: Params) -> DataFrame:
    """Sparse daily total demand per item: consumption plus sales."""
    from partcast.operators.extract import sales_daily

    sales = sales_daily(t, p).select("item_id", "ds", F.col("quantity").alias("qty"))
    both = daily_consumption(t, p, window_start(p), p.as_of).select("item_id", "ds", "qty").unionByName(sales)
    return both.where(F.col("item_id").isNotNull()).groupBy("item_id", "ds").agg(F.sum("qty").alias("qty"))


def demand_events(t: Tables, p: Params, event_type: str | None = None) -> DataFrame:
    """Sparse daily event value per user in the trailing window."""
    from partcast.functions.cols import ts_between_days

    ev = t.events.where(ts_between_days(F.col("ts"), window_start(p), p.as_of))
    if event_type is not None:
        ev = ev.where(F.col("event_type") == event_type)
    return (ev.where(F.col("user_id").isNotNull())
            .groupBy(F.col("user_id").alias("item_id"), F.to_date("ts").alias("ds"))
            .agg(F.sum("value").alias("qty")))


def demand_source(t: Tables, p: Params, name: str) -> DataFrame:
    if name == "parts":
        return demand_parts(t, p)
    if name == "total":
        return demand_total(t, p)
    if name == "family":
        return demand_family(t, p)
    if name == "events_all":
        return demand_events(t, p)
    if name == "events_purchase":
        return demand_events(t, p, "purchase")
    raise ValueError(f"unknown demand source {name!r}")


# -- densification ---------------------------------------------------------------------
def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by ``keys`` (the item) over all of ``spark.sql.shuffle.partitions``.  A number asked for is kept:
    adaptive execution would merge partitions by the size of the observed days and leave one
    task with hundreds of times as many filled ones."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys or ("item_id",)))


def _steps(first: str, last: str):
    """0 .. the days from the first to the last: a sequence of days costs several times as much."""
    return F.sequence(F.lit(0), F.datediff(last, first))


def densify_own_span(daily: DataFrame, value: str = "qty") -> DataFrame:
    """Fill missing days with 0 between each item's own first and last day."""
    nxt = F.lead("ds").over(by_item())
    return (spread(daily.where(F.col("item_id").isNotNull() & F.col("ds").isNotNull()))
            .select("item_id", "ds", value, F.coalesce(F.date_sub(nxt, 1), F.col("ds")).alias("seg_end"))
            .select("item_id", "ds", value, F.explode(_steps("ds", "seg_end")).alias("d"))
            .select("item_id", F.date_add("ds", F.col("d")).alias("ds"),
                    F.when(F.col("d") == 0, F.col(value)).otherwise(F.lit(0.0)).alias(value)))


def densify_fixed_window(daily: DataFrame, start: dt.date, end: dt.date, value: str = "qty") -> DataFrame:
    """Re-index every item onto the same [start, end] calendar (days outside dropped)."""
    lo, hi = F.lit(start), F.lit(end)
    inside = spread(daily.where(F.col("item_id").isNotNull() & (F.col("ds") >= lo) & (F.col("ds") <= hi)))
    prv = F.lag("ds").over(by_item())
    nxt = F.lead("ds").over(by_item())
    return (inside.select("item_id", "ds", value,
                          F.when(prv.isNull(), lo).otherwise(F.col("ds")).alias("seg_start"),
                          F.coalesce(F.date_sub(nxt, 1), hi).alias("seg_end"))
            .select("item_id", "ds", value, "seg_start", F.explode(_steps("seg_start", "seg_end")).alias("d"))
            .select("item_id", F.date_add("seg_start", F.col("d")).alias("ds"),
                    F.when(F.date_add("seg_start", F.col("d")) == F.col("ds"), F.col(value)).otherwise(F.lit(0.0)).alias(value)))


def dense_series(t: Tables, p: Params, source: str = "parts", span: str = "own") -> DataFrame:
    """Dense (item_id, ds, qty) for a demand source; ``span`` is 'own' or 'fixed'."""
    daily = demand_source(t, p, source)
    if span == "own":
        return densify_own_span(daily)
    return densify_fixed_window(daily, window_start(p), p.as_of)


def aggregate_demand(t: Tables, p: Params) -> DataFrame:
    """Item universe = sales + consumption + purchase items; dates = span of sales
    and consumption days; left-join the daily sums; total = sales + consumption.

    The three sources are united and summed once (written to shared storage); the
    span, the items and the values all come from those sums.  Every item gets a
    first row at the start of the span and each row fills the days up to the
    next one.  Purchase quantities are not summed.
    """
    from partcast.operators.extract import purchase_lines, sales_daily
    from partcast.session import cut_lineage

    none = F.lit(0.0)
    sales = sales_daily(t, p).select("item_id", "ds", F.col("quantity").alias("sales_qty"), none.alias("consumption_qty"))
    cons = daily_consumption(t, p, window_start(p), p.as_of).select("item_id", "ds", none.alias("sales_qty"), F.col("qty").alias("consumption_qty"))
    bought = purchase_lines(t, p).select("item_id", F.lit(None).cast("date").alias("ds"), none.alias("sales_qty"), none.alias("consumption_qty"))
    sums = [F.sum(c).alias(c) for c in ("sales_qty", "consumption_qty")]
    daily = cut_lineage(sales.unionByName(cons).unionByName(bought).where(F.col("item_id").isNotNull())
                        .groupBy("item_id", "ds").agg(*sums))
    lo, hi = (daily.agg(f("ds")).scalar() for f in (F.min, F.max))
    anchors = daily.select("item_id").distinct().select("item_id", lo.alias("ds"), none.alias("sales_qty"), none.alias("consumption_qty"))
    rows = daily.where(F.col("ds").isNotNull()).unionByName(anchors).groupBy("item_id", "ds").agg(*sums)
    until = F.coalesce(F.date_sub(F.lead("ds").over(by_item()), 1), hi)
    days = rows.withColumn("until", until).withColumn("d", F.explode(F.sequence("ds", "until")))
    out = days.select(F.col("d").alias("ds"), "item_id",
                      *[F.when(F.col("d") == F.col("ds"), F.col(c)).otherwise(none).alias(c) for c in ("sales_qty", "consumption_qty")])
    return out.withColumn("total_demand", F.col("sales_qty") + F.col("consumption_qty"))


def series_union_dates(t: Tables, p: Params) -> DataFrame:
    """Distinct dates of sales and consumption: first, last and count."""
    from partcast.operators.extract import sales_daily

    days = (sales_daily(t, p).select("ds")
            .union(daily_consumption(t, p, window_start(p), p.as_of).select("ds")).distinct())
    return days.agg(F.min("ds").alias("min_date"), F.max("ds").alias("max_date"),
                    F.count(F.lit(1)).alias("n_dates"))


def _top_dense(t: Tables, p: Params, n: int) -> DataFrame:
    """Top-n items over the window, ranked, each densified on the whole window."""
    daily = daily_consumption(t, p, window_start(p), p.as_of)
    top = (daily.groupBy("item_id").agg(F.sum("qty").alias("total"))
           .orderBy(F.desc("total"), F.asc("item_id")).limit(n))
    rank = F.row_number().over(Window.orderBy(F.desc("total"), F.asc("item_id")))     # n rows
    dense = densify_fixed_window(daily.join(top, "item_id", "left_semi"), window_start(p), p.as_of)
    return dense.join(top.select("item_id", rank.alias("rank")), "item_id")


def pivot_top(t: Tables, p: Params, n: int | None = None) -> DataFrame:
    """One row per day, one column per rank (``top_01`` is the item with the largest
    total).  The columns are known before any data is read."""
    n = n or p.top_n
    slots = [f"top_{k:02d}" for k in range(1, n + 1)]
    dense = _top_dense(t, p, n).withColumn("slot", F.format_string("top_%02d", F.col("rank")))
    return dense.groupBy("ds").pivot("slot", slots).agg(F.sum("qty")).fillna(0.0)


def pivot_items(t: Tables, p: Params, n: int | None = None) -> DataFrame:
    """The same with the items themselves as columns (wide export files); the pivot
    width is bounded by n."""
    return (_top_dense(t, p, n or p.top_n).withColumn("item", F.col("item_id").cast("string"))
            .groupBy("ds").pivot("item").agg(F.sum("qty")).fillna(0.0))


# -- splits ----------------------------------------------------------------------------
def with_position(dense: DataFrame) -> DataFrame:
    """Adds rn (0-based day index) and n (series length) per item."""
    w_all = Window.partitionBy("item_id")
    return (dense.withColumn("rn", (F.row_number().over(by_item()) - 1).cast("int"))
                 .withColumn("n", F.count(F.lit(1)).over(w_all).cast("int")))


def split_holdout(dense: DataFrame, horizon: int, min_train: int) -> DataFrame:
    """Last ``horizon`` rows are test; items with fewer than ``min_train``
    training rows are dropped (the reference skips them)."""
    pos = with_position(dense)
    return (pos.where(F.col("n") - horizon >= min_train)
            .select("item_id", "ds", "qty",
                    F.when(F.col("rn") >= F.col("n") - horizon, F.lit("test"))
                    .otherwise(F.lit("train")).alias("split")))


def split_80_20(dense: DataFrame, min_rows: int) -> DataFrame:
    """First floor(0.8 n) rows train, the rest validation; items with fewer than
    ``min_rows`` rows are labelled insufficient_data."""
    pos = with_position(dense)
    cut = F.floor(F.col("n") * F.lit(0.8))
    return pos.select("item_id", "ds", "qty",
                      F.when(F.col("n") < min_rows, F.lit("insufficient_data"))
                      .when(F.col("rn") < cut, F.lit("train"))
                      .otherwise(F.lit("validation")).alias("split"))
