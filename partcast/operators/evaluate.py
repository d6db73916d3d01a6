"""Forecast evaluation: error, intermittent, inventory and
asymmetric metrics, winners and leaderboards.

Input is the long *evaluation* table (item_id, method, h, ds, y, yhat): the
forecast rows joined to the hold-out actuals on (item_id, ds).  Every metric
is a grouped aggregate over it -- per (item, method) or coarser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partcast.functions.cols import count_if
from partcast.operators.ranks import medians

EPS_MAPE = 1e-8
EPS_CHANGE = 1e-10


def _err() -> Column:
    return F.col("y") - F.col("yhat")


def error_metrics(ev: DataFrame, keys=("item_id", "method")) -> DataFrame:
    e = _err()
    return ev.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e / (F.col("y") + EPS_MAPE))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("n_points"),
    )


def mae_rmse(ev: DataFrame, keys=("item_id", "method")) -> DataFrame:
    return error_metrics(ev, keys).select(*keys, "mae", "rmse")


def mape(ev: DataFrame, keys=("item_id", "method")) -> DataFrame:
    return error_metrics(ev, keys).select(*keys, "mape")


def intermittent_metrics(ev: DataFrame, keys=("item_id", "method")) -> DataFrame:
    y, f = F.col("y"), F.col("yhat")
    g = ev.groupBy(*keys).agg(
        count_if((y == 0) & (f == 0)).alias("correct_zeros"),
        count_if((y > 0) & (f > 0)).alias("correct_direction"),
        F.sum(f).alias("total_forecast"), F.sum(y).alias("total_actual"))
    return g.withColumn("forecast_error_pct",
                        F.abs(F.col("total_forecast") - F.col("total_actual"))
                        / (F.col("total_actual") + EPS_MAPE) * 100)


def inventory_metrics(ev: DataFrame, keys=("item_id", "method"), holding_cost: float = 1.0,
                      stockout_cost: float = 3.0) -> DataFrame:
    """Stock-out = under-forecast (y > yhat).  Rates, mean stock-out / overstock,
    total cost (stock-out units x 3 + overstock units x 1) and service level."""
    e = _err()
    g = ev.groupBy(*keys).agg(
        count_if(e > 0).alias("_so_n"), F.count(F.lit(1)).alias("_n"),
        F.avg(F.when(e > 0, e)).alias("_so_avg"), F.avg(F.when(e < 0, -e)).alias("_os_avg"),
        F.coalesce(F.sum(F.when(e > 0, e)), F.lit(0.0)).alias("_so_sum"),
        F.coalesce(F.sum(F.when(e < 0, -e)), F.lit(0.0)).alias("_os_sum"))
    rate = F.col("_so_n") / F.col("_n")
    return g.select(*keys, rate.alias("stockout_rate"),
                    F.coalesce("_so_avg", F.lit(0.0)).alias("avg_stockout"),
                    F.coalesce("_os_avg", F.lit(0.0)).alias("avg_overstock"),
                    (F.col("_so_sum") * stockout_cost + F.col("_os_sum") * holding_cost).alias("total_cost"),
                    (F.lit(1.0) - rate).alias("service_level"))


def asymmetric_metrics(ev: DataFrame, keys=("item_id", "method"), penalty: float = 3.0,
                       holding_cost: float = 1.0) -> DataFrame:
    """Inventory view with separate costs and the asymmetric loss: mean squared
    error with under-forecasts weighted by ``penalty``."""
    e = _err()
    g = ev.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"),
        (count_if(e > 0) / F.count(F.lit(1))).alias("stockout_rate"),
        (count_if(e < 0) / F.count(F.lit(1))).alias("overstock_rate"),
        (F.coalesce(F.sum(F.when(e > 0, e)), F.lit(0.0)) * penalty).alias("stockout_cost"),
        (F.coalesce(F.sum(F.when(e < 0, -e)), F.lit(0.0)) * holding_cost).alias("overstock_cost"),
        F.avg(F.when(e > 0, F.lit(penalty)).otherwise(F.lit(1.0)) * e * e).alias("asymmetric_loss"))
    return g.withColumn("total_cost", F.col("stockout_cost") + F.col("overstock_cost"))


def best_method(metrics: DataFrame, key: str = "item_id") -> DataFrame:
    """Arg-min MAE method per item; ties (to 1e-9) go to the smaller method name."""
    w = Window.partitionBy(key).orderBy(F.round("mae", 9), "method")
    return (metrics.where(F.col("mae").isNotNull())
            .withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select(key, F.col("method").alias("best_method"), F.col("mae").alias("best_mae")))


def method_leaderboard(metrics: DataFrame) -> DataFrame:
    """Mean and sample std of MAE per method, ranked by mean (over <= #methods rows)."""
    g = metrics.groupBy("method").agg(F.avg("mae").alias("mean_mae"), F.stddev_samp("mae").alias("std_mae"),
                                      F.count(F.lit(1)).alias("n_items"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.round("mean_mae", 9), "method")))


def compare_vs_baseline(candidate: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per item: candidate MAE vs its best baseline, improvement % and win flag.
    ``candidate`` has (item_id, mae); ``baselines`` has (item_id, method, mae)."""
    best = best_method(baselines)
    c = candidate.select("item_id", F.col("mae").alias("candidate_mae"))
    j = c.join(best, "item_id")
    return j.select(
        "item_id", "candidate_mae", F.col("best_method").alias("best_baseline"),
        F.col("best_mae").alias("baseline_mae"),
        F.try_divide((F.col("best_mae") - F.col("candidate_mae")) * 100, F.nullif(F.col("best_mae"), F.lit(0.0)))
        .alias("improvement_pct"),
        (F.col("candidate_mae") < F.col("best_mae")).alias("candidate_wins"))


def multiseries_metrics(ev: DataFrame, categories: DataFrame) -> DataFrame:
    """Three grains in one table: overall (all points), per series (MAE, MAPE),
    and the mean series MAE per volume category (and over all series).  The
    per-series table feeds three branches and is checkpointed once."""
    from partcast.session import cut_lineage

    per = cut_lineage(error_metrics(ev, ("item_id",)))
    overall = per.agg((F.sum(F.col("mae") * F.col("n_points")) / F.sum("n_points")).alias("mae"),
                      F.count(F.lit(1)).alias("n_items")).select(
        F.lit("overall").alias("grain"), F.lit(None).cast("string").alias("key"), "mae",
        F.lit(None).cast("double").alias("mape"), "n_items")
    series = per.select(F.lit("series").alias("grain"), F.col("item_id").cast("string").alias("key"), "mae",
                        "mape", F.lit(1).cast("bigint").alias("n_items"))
    mean_all = per.agg(F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("n_items")).select(
        F.lit("series_mean").alias("grain"), F.lit(None).cast("string").alias("key"), "mae",
        F.lit(None).cast("double").alias("mape"), "n_items")
    by_cat = (per.join(categories.select("item_id", "category"), "item_id")
              .groupBy("category").agg(F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("n_items"))
              .select(F.lit("category").alias("grain"), F.col("category").alias("key"), "mae",
                      F.lit(None).cast("double").alias("mape"), "n_items"))
    return overall.unionByName(series).unionByName(mean_all).unionByName(by_cat)


def model_performance_table(metrics: DataFrame, volumes: DataFrame, failures: DataFrame,
                            days: int = 365) -> DataFrame:
    """Per item mae / rmse / mape with annual and daily mean volume, plus one
    row per failed item with its reason (metrics NULL)."""
    ok = (metrics.join(volumes, "item_id", "left")
          .select("item_id", "mae", "rmse", "mape", "annual_consumption",
                  (F.col("annual_consumption") / float(days)).alias("avg_daily_consumption"),
                  F.lit(None).cast("string").alias("failure_reason")))
    bad = failures.select("item_id", *[F.lit(None).cast("double").alias(c) for c in
                                       ("mae", "rmse", "mape", "annual_consumption", "avg_daily_consumption")],
                          "failure_reason")
    return ok.unionByName(bad)


def training_summary(results: DataFrame) -> DataFrame:
    """Per status: parts, share of all parts, and MAE mean / median / min / max."""
    g = results.groupBy("status").agg(
        F.count(F.lit(1)).alias("parts"), F.avg("mae").alias("mean_mae"),
        F.min("mae").alias("min_mae"), F.max("mae").alias("max_mae"))
    g = g.join(medians(results, "mae", "status").withColumnRenamed("median", "median_mae"), "status", "left")
    return g.withColumn("pct_of_parts", F.col("parts") / F.sum("parts").over(Window.partitionBy()) * 100)


def training_results_baseline(daily: DataFrame, p, method: str = "MA_7", stock_codes: DataFrame | None = None
                              ) -> DataFrame:
    """Training-results table for a baseline over sparse daily sums: status per part
    (insufficient_data below ``train_points`` observed days, insufficient_valid_data
    below ``min_train`` days from first to last, else success), zero share, 80/20
    split sizes and validation MAE of ``method`` fitted on the first 80%."""
    from partcast.operators.baselines import forecast_constants
    from partcast.operators.reshape import densify_own_span

    observed = daily.groupBy("item_id").agg(F.countDistinct("ds").alias("points"))
    dense = densify_own_span(daily)
    w = Window.partitionBy("item_id").orderBy("ds")
    pos = dense.withColumns({"_rn": F.row_number().over(w) - 1,
                             "_n": F.count(F.lit(1)).over(Window.partitionBy("item_id"))})
    cut = F.floor(F.col("_n") * 0.8)
    stats = pos.groupBy("item_id").agg(
        F.max("_n").alias("n"),
        (F.avg(F.when(F.col("qty") == 0, 1.0).otherwise(0.0)) * 100).alias("zero_pct"))
    eligible = pos.where(F.col("_n") >= p.min_train)
    train = eligible.where(F.col("_rn") < cut).select("item_id", "ds", "qty")
    valid = eligible.where(F.col("_rn") >= cut).select("item_id", "ds", "qty")
    consts = forecast_constants(train, p.ses_alpha, p.croston_alpha).select("item_id", F.col(method).alias("yhat"))
    mae = (valid.join(consts, "item_id").groupBy("item_id")
           .agg(F.avg(F.abs(F.col("qty") - F.col("yhat"))).alias("mae"),
                F.count(F.lit(1)).alias("val_samples")))
    out = stats.join(observed, "item_id").join(mae, "item_id", "left")
    few, short = F.col("points") < p.train_points, F.col("n") < p.min_train
    ok = ~few & ~short
    out = out.select(
        F.col("item_id").alias("part_id"),
        F.when(few, "insufficient_data").when(short, "insufficient_valid_data").otherwise("success").alias("status"),
        "zero_pct", F.when(ok, F.col("mae")).alias("mae"),
        F.when(ok, F.floor(F.col("n") * 0.8)).cast("bigint").alias("train_samples"),
        F.when(ok, F.col("val_samples")).cast("bigint").alias("val_samples"),
        F.when(few, F.concat(F.lit("Only "), F.col("points").cast("string"), F.lit(" data points")))
        .when(short, F.concat(F.lit("Only "), F.col("n").cast("string"), F.lit(" valid samples"))).alias("error"))
    if stock_codes is not None:
        out = out.join(stock_codes.select(F.col("item_id").alias("part_id"), F.col("stk_code").alias("stock_code")),
                       "part_id", "left")
    return out
