"""Set-based baseline and intermittent-demand forecasters.

Every method is evaluated for all items in one pass: a window over the
item-partitioned training rows annotates positions (row index, positive
rank, previous positive index), then one grouped aggregation evaluates each
method in closed form.  The recursive smoothers unroll into weighted sums:

* SES (alpha):   sum_{i<=n-2} a(1-a)^(n-2-i) x_i + (1-a)^(n-1) x_0
* Croston:       z = (1-a)^(k-1) y_1 + sum_{j>=2} a(1-a)^(k-j) y_j, interval p likewise
                 with p_1 = t_1 + 1 and p_j = t_j - t_{j-1}; forecast z / p
* TSB:           p = (1-a)^n / (t_1 + 1) + sum_t a(1-a)^(n-1-t) [x_t > 0]; forecast max(p z, 0)

Positions are *day indices* (days since the series start), so the input may
be dense or sparse: a day without a row counts as zero demand.  Sums, means,
counts and point look-ups are written for that (``sum / n`` instead of
``avg``, ``coalesce(..., 0)`` for a missing day), which lets the forecasters
run straight on the sparse daily sums -- for intermittent parts a small
fraction of the densified rows.  The window and the aggregation share the
``item_id`` partitioning, so a forecaster adds no exchange beyond the one that
built the daily sums.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partcast.functions.windows import before, by_item, item_all, upto


# Method names as reported.
METHODS = ("MA_7", "MA_14", "MA_30", "WMA_7", "Naive", "Seasonal_7", "ExpSmooth",
           "Croston", "SBA", "TSB", "MA_NonZero", "Mean")


def annotate(series: DataFrame, holdout: int = 0, start: dt.date | Column | None = None,
             end: dt.date | Column | None = None) -> DataFrame:
    """Adds rn (day index from the series start), n (training length in days =
    days in the span - holdout), k (positive training days), pr (positive rank,
    1-based) and gap (days since the previous positive day; rn + 1 for the
    first).  The span is [start, end] when given (a day, or a column of each item's),
    else the item's own first to last day.  Days with rn >= n are hold-out days."""
    pos = F.col("qty") > 0
    first = F.lit(start) if start is not None else F.min("ds").over(item_all())
    last = F.lit(end) if end is not None else F.max("ds").over(item_all())
    df = series.withColumns({"_start": first, "_end": last})
    df = df.withColumns({
        "rn": F.datediff("ds", "_start").cast("int"),
        "n": (F.datediff("_end", "_start") + 1 - holdout).cast("int"),
    })
    tpos = pos & (F.col("rn") < F.col("n"))
    df = df.withColumns({
        "k": F.sum(F.when(tpos, 1).otherwise(0)).over(item_all()).cast("int"),
        "pr": F.when(tpos, F.sum(F.when(pos, 1).otherwise(0)).over(upto())).cast("int"),
    })
    prev_pos = F.last(F.when(pos, F.col("rn")), ignorenulls=True).over(before())
    return df.withColumn("gap", F.when(tpos, F.col("rn") - F.coalesce(prev_pos, F.lit(-1))))


def _pw(base: float, e: Column) -> Column:
    return F.pow(F.lit(base), e.cast("double"))


def forecast_constants(series: DataFrame, ses_alpha: float = 0.3, croston_alpha: float = 0.1,
                       holdout: int = 0, start: dt.date | Column | None = None, end: dt.date | Column | None = None) -> DataFrame:
    """One row per item: every method's forecast (flat methods) and the seven
    seasonal values, fitted on all but the last ``holdout`` days of the span
    (see :func:`annotate`).  Columns are the method names plus ``season``
    (array of 7), ``train_end``, ``n`` and -- when ``holdout`` > 0 --
    ``actuals``, the hold-out values in day order.  ``series`` may be dense or
    sparse (absent days are zeros)."""
    a, b = ses_alpha, 1 - ses_alpha
    ca, cb = croston_alpha, 1 - croston_alpha
    q, rn, n, k, pr = F.col("qty"), F.col("rn"), F.col("n"), F.col("k"), F.col("pr")
    qt = F.when(rn < n, q)          # training values only
    zero = F.lit(0.0)

    def at(i):                      # value on day index i (0 when the day has no row)
        return F.coalesce(F.max(F.when(rn == i, q)), zero)

    def last_w(w):                  # mean of the last w training days, partial at the start
        return F.coalesce(F.sum(F.when(rn >= n - w, qt)), zero) / F.least(F.max("n"), F.lit(w))

    size_w = F.when(pr == 1, _pw(cb, k - 1)).when(pr >= 2, F.lit(ca) * _pw(cb, k - pr))
    aggs = [
        F.date_add(F.min("_start"), F.max("n") - 1).alias("train_end"),
        F.max("n").alias("n"), F.max("k").alias("k"),
        last_w(7).alias("MA_7"), last_w(14).alias("MA_14"), last_w(30).alias("MA_30"),
        (F.coalesce(F.sum(F.when(rn >= n - 7, qt * (rn - n + 8))), zero) / 28.0).alias("_wma"),
        at(n - 1).alias("Naive"),
        F.array(*[at(n - 8 + j) for j in range(1, 8)]).alias("season"),
        (F.coalesce(F.sum(F.when(rn <= n - 2, F.lit(a) * _pw(b, n - 2 - rn) * q)), zero)
         + _pw(b, F.max("n") - 1) * at(F.lit(0))).alias("ExpSmooth"),
        F.sum(size_w * q).alias("_z"),
        F.sum(size_w * F.col("gap")).alias("_p"),
        F.max(F.when(pr == 1, rn)).alias("_t1"),
        F.sum(F.when(qt > 0, F.lit(ca) * _pw(cb, n - 1 - rn))).alias("_pos_w"),
        F.avg(F.when(pr > k - 3, q)).alias("_last3"),
        (F.coalesce(F.sum(qt), zero) / F.max("n")).alias("Mean"),
    ]
    if holdout:
        aggs.append(F.array(*[at(n + j) for j in range(holdout)]).alias("actuals"))
    g = annotate(series, holdout, start, end).groupBy("item_id").agg(*aggs)
    k, n = F.col("k"), F.col("n")
    croston = F.when(k == 0, F.lit(0.0)).when(F.col("_p") > 0, F.col("_z") / F.col("_p")).otherwise(F.lit(0.0))
    tsb_p = _pw(cb, n) / (F.col("_t1") + 1) + F.coalesce(F.col("_pos_w"), F.lit(0.0))
    extra = ["actuals"] if holdout else []
    return g.select(
        "item_id", "train_end", "n", "MA_7", "MA_14", "MA_30",
        F.when(n >= 7, F.col("_wma")).alias("WMA_7"),
        "Naive", "season", "ExpSmooth",
        croston.alias("Croston"),
        (croston * (1 - croston_alpha / 2)).alias("SBA"),
        F.when(k == 0, F.lit(0.0)).otherwise(F.greatest(tsb_p * F.col("_z"), F.lit(0.0))).alias("TSB"),
        F.when(k == 0, F.lit(0.0)).otherwise(F.col("_last3") * k / n).alias("MA_NonZero"),
        "Mean", *extra,
    )


def to_long(consts: DataFrame, methods=METHODS, horizon: int = 14) -> DataFrame:
    """Forecast rows (item_id, method, h, ds, yhat) for h = 1..horizon.
    Seasonal_7 repeats last week's position for h <= 7 and the last value after."""
    entries = [F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("v")) for m in methods
               if m != "Seasonal_7"]
    has_season = "Seasonal_7" in methods
    if has_season:
        entries.append(F.struct(F.lit("Seasonal_7").alias("method"), F.lit(None).cast("double").alias("v")))
    carry = ["actuals"] if "actuals" in consts.columns else []
    out = (consts.select("item_id", "train_end", "season", "Naive", *carry, F.explode(F.array(*entries)).alias("m"))
           .select("item_id", "train_end", "season", "Naive", *carry, "m.method", "m.v",
                   F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")))
    season_val = F.when(F.col("h") <= 7, F.element_at("season", F.col("h"))).otherwise(F.col("Naive"))
    yhat = F.when(F.col("method") == "Seasonal_7", season_val).otherwise(F.col("v")) if has_season else F.col("v")
    y = [F.element_at("actuals", F.col("h")).alias("y")] if carry else []
    return out.select("item_id", "method", F.col("h").cast("int").alias("h"),
                      F.date_add("train_end", F.col("h")).alias("ds"), *y, yhat.alias("yhat"))


def same_weekday_fitted(series: DataFrame, weeks: int = 4) -> DataFrame:
    """In-sample mean of the same weekday over the previous ``weeks`` weeks,
    defined from row 7*weeks on (NULL before)."""
    rn = F.row_number().over(by_item()) - 1
    mean = sum(F.lag("qty", 7 * w).over(by_item()) for w in range(1, weeks + 1)) / float(weeks)
    return series.withColumn("_rn", rn).withColumn(
        "fitted", F.when(F.col("_rn") >= 7 * weeks, mean)).drop("_rn")


def holdout_constants(series: DataFrame, p, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Constants fitted on all but the last ``p.horizon`` days of every item
    whose training part has at least ``p.min_train`` days, carrying the hold-out
    actuals -- one grouped pass, no join."""
    c = forecast_constants(series, p.ses_alpha, p.croston_alpha, p.horizon, start, end)
    return c.where(F.col("n") >= p.min_train)


def forecasts(series: DataFrame, p, methods=METHODS, start: dt.date | None = None,
              end: dt.date | None = None) -> DataFrame:
    """Fit on all but the last ``p.horizon`` days and forecast them."""
    return to_long(holdout_constants(series, p, start, end), methods, p.horizon).drop("y")


def evaluation_rows(series: DataFrame, p, methods=METHODS, start: dt.date | None = None,
                    end: dt.date | None = None) -> DataFrame:
    """(item_id, method, h, ds, y, yhat) for the hold-out: forecasts and actuals
    come out of the same per-item aggregate, so no join is needed."""
    return to_long(holdout_constants(series, p, start, end), methods, p.horizon)


# Inferred selection thresholds on the share of zero days.
SELECT_RULES = ((30.0, "MA_7"), (60.0, "Croston"), (85.0, "SBA"))


def baseline_select(dense: DataFrame, p, validation_share: float = 0.2) -> DataFrame:
    """Pick a baseline per item by its share of zero days (MA_7 / Croston / SBA /
    ensemble of the three), fit on the first 80% of rows and score the last 20%.

    The dense rows are only counted and searched for days with demand; windows,
    sorts and joins see these days and one row per item."""
    span = dense.groupBy("item_id").agg(F.min("ds").alias("_first"), F.count(F.lit(1)).cast("int").alias("_n"))
    span = span.withColumn("_cut", F.floor(F.col("_n") * (1 - validation_share)).cast("int")).where(F.col("_cut") > 0)
    rows = span.join(dense.where(~F.col("qty").eqNullSafe(F.lit(0.0))), "item_id", "left")
    cut, day = F.col("_cut"), F.datediff("ds", "_first")
    consts = forecast_constants(rows, p.ses_alpha, p.croston_alpha, 0, F.col("_first"), F.date_add("_first", cut - 1))
    share = rows.groupBy("item_id", "_n", "_cut").agg(F.count(F.when(day < cut, 1)).alias("_busy")).select(
        "item_id", "_n", "_cut", ((cut - F.col("_busy")).cast("double") / cut * 100).alias("zero_pct"))
    z = F.col("zero_pct")
    method = F.when(z < SELECT_RULES[0][0], SELECT_RULES[0][1]).when(z < SELECT_RULES[1][0], SELECT_RULES[1][1]) \
        .when(z < SELECT_RULES[2][0], SELECT_RULES[2][1]).otherwise("Ensemble")
    ens = (F.col("MA_7") + F.col("Croston") + F.col("SBA")) / 3.0
    chosen = consts.select("item_id", "MA_7", "Croston", "SBA").join(share, "item_id").withColumn("selected_method", method).withColumn(
        "yhat", F.when(method == "MA_7", F.col("MA_7")).when(method == "Croston", F.col("Croston"))
        .when(method == "SBA", F.col("SBA")).otherwise(ens))
    late = rows.where(day >= cut).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct(day, "qty"))).alias("_late"))
    at = lambda d: F.when(F.map_contains_key("_late", d), F.element_at("_late", d)).otherwise(F.lit(0.0))
    off = F.filter(F.transform(F.sequence(cut, F.col("_n") - 1), lambda d: F.abs(at(d) - F.col("yhat"))), F.isnotnull)
    total = F.aggregate(off, F.lit(0.0), lambda s, v: s + v)
    return chosen.join(late, "item_id", "left").select(
        "item_id", "zero_pct", "selected_method", "yhat", F.when(F.size(off) > 0, total / F.size(off)).alias("validation_mae"))
