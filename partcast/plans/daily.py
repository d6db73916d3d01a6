"""The daily procurement flow -- the flagship plan behind ``entry``.

consumption lines -> sparse daily sums over the trailing window ->
demand state (time since demand, rolling stats) + MA-of-non-zero forecast ->
safety stock -> per-part priority (URGENT / WARNING / NONE).

Physical shape: the line/header join feeds a partial aggregation and one
exchange on (item_id, ds); the daily sums are then exchanged once on
item_id and *everything else* -- the rank window, the forecast, the
horizon rows and the order decision -- runs inside those partitions (one sort,
one window group, one aggregation that reuses the partitioning).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partcast.operators import baselines as B
from partcast.operators import reshape as R
from partcast.params import Params
from partcast.sources.tables import Tables

STATE = ("time_since_last_demand", "rolling_mean_7", "rolling_std_7", "rolling_mean_30", "rolling_max_30")


def daily_plan(t: Tables, p: Params) -> DataFrame:
    start = p.as_of - dt.timedelta(days=p.days_back)
    daily = R.demand_parts(t, p)          # sparse daily sums: absent days are zero demand
    q, rn, n, k, pr = F.col("qty"), F.col("rn"), F.col("n"), F.col("k"), F.col("pr")
    zero = F.lit(0.0)
    # The plan needs the *latest* demand state only, so the rolling statistics are
    # conditional aggregates over the last w days -- no per-row sliding frames, and
    # no densified rows: sums and counts over the day index treat absent days as 0.
    last_pos = F.max(F.when(q > 0, rn))

    def wsum(w, v=q):
        return F.coalesce(F.sum(F.when(rn >= n - w, v)), zero)

    m7 = F.least(F.max("n"), F.lit(7)).cast("double")
    s7, ss7 = wsum(7), wsum(7, q * q)
    rows30 = F.sum(F.when(rn >= n - 30, 1).otherwise(0))
    per_item = B.annotate(daily, 0, start, p.as_of).groupBy("item_id").agg(
        F.max("n").alias("n"), F.max("k").alias("k"),
        F.avg(F.when(pr > k - 3, q)).alias("_last3"),
        F.coalesce(F.max("n") - 1 - last_pos, F.lit(0)).alias("time_since_last_demand"),
        (s7 / m7).alias("rolling_mean_7"),
        F.when(m7 > 1, F.sqrt(F.greatest((ss7 - s7 * s7 / m7) / (m7 - 1), zero))).alias("rolling_std_7"),
        (wsum(30) / F.least(F.max("n"), F.lit(30))).alias("rolling_mean_30"),
        F.when(rows30 < F.least(F.max("n"), F.lit(30)),
               F.greatest(F.max(F.when(rn >= n - 30, q)), zero))
        .otherwise(F.max(F.when(rn >= n - 30, q))).alias("rolling_max_30"))
    forecast = F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.col("_last3") * F.col("k") / F.col("n"))
    per_item = per_item.withColumn("forecast_daily", forecast)

    # horizon rows (MA_NonZero is flat, but the decision logic does not rely on it)
    rows = per_item.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(p.horizon))))
    pd_ = F.bround(F.col("forecast_daily"), 0)
    ss = F.bround(F.col("forecast_daily") * p.safety_factor, 0)
    urgent, warning = F.col("h") <= p.urgent_days, (F.col("h") > p.urgent_days) & (F.col("h") <= p.warning_days)
    plan = rows.groupBy("item_id", "forecast_daily", *STATE).agg(
        F.sum(pd_).alias("horizon_demand"),
        F.sum(F.when(urgent, pd_)).alias("urgent_demand"),
        F.sum(F.when(warning, pd_)).alias("warning_demand"),
        F.max(F.when(urgent, ss)).alias("_ss_urgent"),
        F.max(F.when(warning, ss)).alias("_ss_warning"))
    is_urgent, is_warning = F.col("urgent_demand") > 0, F.col("warning_demand") > 0
    return plan.select(
        "item_id", "forecast_daily", "horizon_demand", "urgent_demand", "warning_demand",
        F.when(is_urgent, F.col("_ss_urgent")).when(is_warning, F.col("_ss_warning")).otherwise(F.lit(0.0))
        .alias("safety_stock"),
        F.when(is_urgent, "URGENT").when(is_warning, "WARNING").otherwise("NONE").alias("priority"),
        F.when(is_urgent, F.lit(p.as_of))
        .when(is_warning, F.lit(p.as_of + dt.timedelta(days=p.warning_days - 2))).alias("order_by_date"),
        *STATE)


def flagship(spark: SparkSession, sf_dir: str, p: Params | None = None) -> DataFrame:
    return daily_plan(Tables(spark, sf_dir), p or Params())
