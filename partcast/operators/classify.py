"""Demand classification.

Syntetos-Boylan metrics need only the positive days and the series length,
so :func:`series_profile` computes them from the *sparse* daily rows plus the
calendar span -- one grouped aggregation, no densified rows.  Metrics that
need every day (quantiles, zero-run starts) use the dense series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partcast.functions.cols import count_if

# Syntetos-Boylan cut-offs.
ADI_CUT = 1.32
CV2_CUT = 0.49


def series_profile(daily: DataFrame, n_days: int | None = None) -> DataFrame:
    """Per item: length n, positive / zero day counts, total, ADI, CV² of
    positives, mean positive, max.  ``n_days`` fixes the series length (fixed
    window); otherwise the length is the item's own first-to-last-day span."""
    q = F.col("qty")
    pos = F.when(q > 0, q)
    g = (daily.where(F.col("item_id").isNotNull())
         .groupBy("item_id")
         .agg(F.sum(q).alias("total_demand"),
              count_if(q > 0).alias("periods_with_demand"),
              count_if(q != 0).alias("_nonzero_rows"),
              F.count(F.lit(1)).alias("_rows"),
              F.min("ds").alias("_first"), F.max("ds").alias("_last"),
              F.min(F.when(q > 0, F.col("ds"))).alias("_first_pos"),
              F.max(F.when(q > 0, F.col("ds"))).alias("_last_pos"),
              F.stddev_samp(pos).alias("_sd_pos"), F.avg(pos).alias("_mean_pos"),
              F.max(q).alias("_max")))
    n = F.lit(n_days).cast("bigint") if n_days else (F.datediff("_last", "_first") + 1).cast("bigint")
    g = g.withColumn("n_periods", n)
    k = F.col("periods_with_demand")
    adi = F.when(k > 1, F.datediff("_last_pos", "_first_pos") / (k - 1)).otherwise(F.col("n_periods").cast("double"))
    cv2 = (F.when(k == 0, F.lit(0.0))
           .when(F.col("_mean_pos") > 0, F.pow(F.col("_sd_pos") / F.col("_mean_pos"), 2))
           .otherwise(F.lit(0.0)))
    has_gaps = F.col("n_periods") > F.col("_rows")
    return g.select(
        "item_id", "n_periods", "total_demand", "periods_with_demand",
        (F.col("n_periods") - F.col("_nonzero_rows")).alias("periods_without_demand"),
        (k / F.col("n_periods") * 100).alias("demand_percentage"),
        adi.alias("adi"), cv2.alias("cv2"),
        F.coalesce(F.col("_mean_pos"), F.lit(0.0)).alias("mean_demand_when_positive"),
        F.when(has_gaps, F.greatest(F.col("_max"), F.lit(0.0))).otherwise(F.col("_max")).alias("max_demand"),
    )


def sbc_label(adi, cv2):
    """Smooth / Intermittent / Erratic / Lumpy; an undefined CV² (one positive
    day) fails every test and lands in Lumpy."""
    return (F.when(cv2.isNull(), F.lit("Lumpy"))
            .when((adi < ADI_CUT) & (cv2 < CV2_CUT), F.lit("Smooth"))
            .when((adi >= ADI_CUT) & (cv2 < CV2_CUT), F.lit("Intermittent"))
            .when((adi < ADI_CUT) & (cv2 >= CV2_CUT), F.lit("Erratic"))
            .otherwise(F.lit("Lumpy")))


def sbc_class(daily: DataFrame, n_days: int | None = None) -> DataFrame:
    prof = series_profile(daily, n_days)
    return prof.withColumn("demand_pattern", sbc_label(F.col("adi"), F.col("cv2")))


def pattern_summary(classes: DataFrame, by=("source",)) -> DataFrame:
    """Per pattern: item count, share of items, mean demand percentage and the
    number of items with demand on < 10% of days.  (Item membership is the
    ``sbc_class`` table itself; it is not gathered into one list.)"""
    by = list(by)
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    per = (classes.groupBy(*by, "demand_pattern")
           .agg(F.count(F.lit(1)).alias("n_items"),
                F.avg("demand_percentage").alias("mean_demand_percentage"),
                count_if(F.col("demand_percentage") < 10).alias("items_below_10pct")))
    return per.withColumn("pct_items", F.col("n_items") / F.sum("n_items").over(w) * 100)


def zero_cv_class(dense: DataFrame) -> DataFrame:
    """Zero share, mean, sample std, CV, zero-run starts, mean interval, max and
    quartiles of the dense series -> SMOOTH / ERRATIC / INTERMITTENT / LUMPY /
    VERY_INTERMITTENT."""
    w = Window.partitionBy("item_id").orderBy("ds")
    is_zero = F.when(F.col("qty") == 0, 1).otherwise(0)
    starts = dense.withColumn("_z", is_zero).withColumn("_start", (F.col("_z") - F.lag("_z").over(w)) == 1)
    q = F.col("qty")
    g = starts.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("total_days"),
        count_if(q > 0).alias("active_days"),
        count_if(q == 0).alias("zero_days"),
        F.avg(q).alias("mean_consumption"),
        F.stddev_samp(q).alias("std_consumption"),
        count_if(F.coalesce(F.col("_start"), F.lit(False))).alias("zero_runs"),
        F.min(F.when(q > 0, F.col("ds"))).alias("_first_pos"),
        F.max(F.when(q > 0, F.col("ds"))).alias("_last_pos"),
        F.max(q).alias("max_consumption"),
        F.percentile(q, 0.25).alias("q25"), F.percentile(q, 0.5).alias("q50"),
        F.percentile(q, 0.75).alias("q75"),
    )
    zp = F.col("zero_days") / F.col("total_days") * 100
    cv = F.when(F.col("mean_consumption") > 0, F.col("std_consumption") / F.col("mean_consumption")) \
        .otherwise(F.lit(float("inf")))
    k = F.col("active_days")
    interval = F.when(k > 1, F.datediff("_last_pos", "_first_pos") / (k - 1)) \
        .otherwise(F.col("total_days").cast("double"))
    g = g.withColumns({"zero_percentage": zp, "coefficient_variation": cv, "avg_interval_days": interval})
    cvc = F.col("coefficient_variation")
    lt = lambda x: F.coalesce(cvc < x, F.lit(False))  # noqa: E731  (NULL std compares as "not below")
    label = (F.when(F.col("zero_percentage") < 20, F.when(lt(0.5), "SMOOTH").otherwise("ERRATIC"))
             .when(F.col("zero_percentage") < 50, F.when(lt(1.0), "INTERMITTENT").otherwise("LUMPY"))
             .otherwise("VERY_INTERMITTENT"))
    return g.withColumn("demand_type", label).drop("_first_pos", "_last_pos")


def volume_class(daily: DataFrame, n_days: int) -> DataFrame:
    """high_volume (total > 1000) / regular (> 30% days) / intermittent (> 10%) / very_intermittent."""
    g = (daily.where(F.col("item_id").isNotNull()).groupBy("item_id")
         .agg(F.sum("qty").alias("total_demand"), count_if(F.col("qty") > 0).alias("demand_days")))
    freq = F.col("demand_days") / F.lit(float(n_days))
    return g.withColumn("demand_frequency", freq).withColumn(
        "category",
        F.when(F.col("total_demand") > 1000, "high_volume").when(freq > 0.3, "regular")
        .when(freq > 0.1, "intermittent").otherwise("very_intermittent"))


def zero_percentage(series: DataFrame) -> DataFrame:
    """Share of zero-demand days over each item's own first-to-last-day span.
    Works on dense series and on sparse daily sums alike (a missing day is a
    zero day), so callers need not densify."""
    days = (F.datediff(F.max("ds"), F.min("ds")) + 1).cast("double")
    nonzero = F.sum(F.when(F.col("qty") != 0, 1).otherwise(0))
    return series.groupBy("item_id").agg(((days - nonzero) / days * 100).alias("zero_pct"))


def model_route(zero_pct: DataFrame) -> DataFrame:
    """Tweedie power 1.3 below 50% zero days, 1.7 below 80%, else the two-stage model."""
    z = F.col("zero_pct")
    return zero_pct.withColumns({
        "model_route": F.when(z < 50, "tweedie_1.3").when(z < 80, "tweedie_1.7").otherwise("two_stage"),
        "tweedie_power": F.when(z < 50, 1.3).when(z < 80, 1.7),
    })


# Data-point ranges and training tiers (label, lower bound, upper bound).
POINT_RANGES = [("100+", 100, None), ("50-99", 50, 99), ("30-49", 30, 49), ("10-29", 10, 29),
                ("5-9", 5, 9), ("1-4", 1, 4)]
TIERS = [("tier_1", 30, None), ("tier_2", 20, 29), ("tier_3", 10, 19), ("tier_4", 1, 9)]


def _bucket(col, spec):
    expr = None
    for label, lo, hi in spec:
        cond = (col >= lo) if hi is None else col.between(lo, hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def _order(col, spec):
    expr = None
    for i, (label, _, _) in enumerate(spec):
        expr = F.when(col == label, i) if expr is None else expr.when(col == label, i)
    return expr


def data_tiers(points: DataFrame) -> DataFrame:
    """Histogram of parts by distinct demand days (``data_points``): the point
    ranges and the training tiers, with share and cumulative share."""
    p = F.col("data_points")
    ranges = points.select(F.lit("range").alias("kind"), _bucket(p, POINT_RANGES).alias("label"))
    tiers = points.select(F.lit("tier").alias("kind"), _bucket(p, TIERS).alias("label"))
    counts = ranges.unionByName(tiers).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("parts_count"))
    order = F.when(F.col("kind") == "range", _order(F.col("label"), POINT_RANGES)) \
        .otherwise(_order(F.col("label"), TIERS))
    w = Window.partitionBy("kind")
    wc = Window.partitionBy("kind").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("_o", order).withColumns({
        "percentage": F.col("parts_count") / F.sum("parts_count").over(w) * 100,
        "cumulative_pct": F.sum("parts_count").over(wc) / F.sum("parts_count").over(w) * 100,
    })
    return out.drop("_o")


# Zero-percentage bins, right-closed; exactly 0 is left unbinned.
ZERO_BINS = [(0, 30), (30, 50), (50, 70), (70, 90), (90, 100)]


def zero_bins(zero_pct: DataFrame) -> DataFrame:
    z = F.col("zero_pct")
    label = None
    for lo, hi in ZERO_BINS:
        cond = (z > lo) & (z <= hi)
        text = F.lit(f"({lo}, {hi}]")
        label = F.when(cond, text) if label is None else label.when(cond, text)
    return (zero_pct.select(label.alias("zero_bin")).where(F.col("zero_bin").isNotNull())
            .groupBy("zero_bin").agg(F.count(F.lit(1)).alias("parts")))
