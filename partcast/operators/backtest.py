"""Expanding-window back-test of the baseline methods.

A refit at every cut-off needs, for these methods, only a window aggregate
evaluated *at the cut-off row* (the mean of the w rows before it, the row
before it, the mean of everything before it).  So instead of replicating the
history once per fold, each row gets its fold number, the forecast is taken
at the fold's first row and carried through the fold with ``last(ignoreNulls)``
-- one sort per item, no data copies, no extra exchange (the fold windows are
clustered by item_id, which the item partitioning already satisfies).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partcast.functions.windows import by_item, item_all, upto

# Back-tested methods.
METHODS = ("MA_7", "MA_14", "MA_30", "Naive", "Mean")


def backtest_baselines(dense: DataFrame, steps: int = 7, initial_share: float = 0.8) -> DataFrame:
    w = by_item()
    pos = dense.withColumns({"rn": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(item_all())})
    init = F.floor(F.col("n") * initial_share)
    pos = pos.withColumn("fold", F.when(F.col("rn") >= init, F.floor((F.col("rn") - init) / steps)))
    at_cut = (F.col("fold").isNotNull()) & (((F.col("rn") - init) % steps) == 0)

    def before(k):
        return w.rowsBetween(-k, -1)

    fc_at_cut = {
        "MA_7": F.avg("qty").over(before(7)), "MA_14": F.avg("qty").over(before(14)),
        "MA_30": F.avg("qty").over(before(30)), "Naive": F.lag("qty", 1).over(w),
        "Mean": F.avg("qty").over(w.rowsBetween(Window.unboundedPreceding, -1)),
    }
    pos = pos.withColumns({f"_c_{m}": F.when(at_cut, e) for m, e in fc_at_cut.items()})
    carried = pos.withColumns({f"_f_{m}": F.last(f"_c_{m}", ignorenulls=True).over(upto()) for m in METHODS})
    rows = carried.where(F.col("fold").isNotNull()).select(
        "item_id", "fold", "qty",
        F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"_f_{m}").alias("yhat")) for m in METHODS]))
        .alias("m"))
    per_fold = (rows.groupBy("item_id", "m.method", "fold")
                .agg(F.avg(F.abs(F.col("qty") - F.col("m.yhat"))).alias("fold_mae")))
    return per_fold.groupBy("item_id", "method").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("fold_mae").alias("mae_mean"),
        F.stddev_samp("fold_mae").alias("mae_std"), F.min("fold_mae").alias("mae_min"),
        F.max("fold_mae").alias("mae_max"))


def backtest_ml(dense: DataFrame, p, steps: int = 7, initial_share: float = 0.8) -> DataFrame:
    """Expanding-window back-test of the global boosted model with a refit per
    fold: for each cut-off (every ``steps`` days after the first
    ``initial_share`` of the shortest series, up to the end of the longest) one
    global model is fitted on all items' history before the cut-off and rolled
    forward ``steps`` days.  An item has the folds that begin within its series.

    The loop runs over cut-offs (bounded by the days of the window), never over
    items; each fold is one distributed fit, and its errors are written before the
    next.  Returns per item the mean / std / min / max of the fold MAEs and the
    same of the fold MAPEs."""
    from partcast.operators import ml as M
    from partcast.session import cut_lineage

    lengths = dense.groupBy("item_id").count().agg(F.min("count").alias("lo"), F.max("count").alias("hi")).first()
    sup = cut_lineage(M.supervised(dense, p.n_lags, 0))          # keeps the 0-based day index rn
    actual = dense.select("item_id", "ds", F.col("qty").alias("y"))
    off = F.abs(F.col("y") - F.col("yhat"))
    out = None
    for fold, cut in enumerate(range(max(int(lengths["lo"] * initial_share), p.n_lags + 1), lengths["hi"], steps)):
        train = sup.where(F.col("rn") < cut)
        model = M.fit_global_gbt(train, p)
        fc = M.recursive_forecast(model, sup, p, F.col("rn") < cut, horizon=steps)
        err = (fc.join(actual, ["item_id", "ds"]).groupBy("item_id")
               .agg(F.avg(off).alias("fold_mae"), (F.avg(off / (F.col("y") + 1e-8)) * 100).alias("fold_mape"))
               .withColumn("fold", F.lit(fold)))
        err = cut_lineage(err)
        out = err if out is None else out.unionByName(err)
    stats = [f(f"fold_{m}").alias(f"{m}_{name}") for m in ("mae", "mape")
             for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return out.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_folds"), *stats)
