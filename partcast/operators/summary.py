"""Summary analytics over training results, alerts and forecasts.

Lists shown to users (high-risk parts, best / worst models) are top-k with a
fixed k, so they are bounded no matter how many parts exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partcast.functions.cols import count_if


def analytics_summary(results: DataFrame, urgency: DataFrame, k: int = 10) -> DataFrame:
    """Parts monitored, accuracy from mean MAE (1 - MAE, or 0.95 when MAE >= 1),
    critical alert count, the first k high-risk parts and the > 90%-zero parts."""
    ok = results.where(F.col("status") == "success")
    risky = urgency.where(F.col("urgency").isin("critical", "high"))
    top = (risky.orderBy(F.when(F.col("urgency") == "critical", 0).otherwise(1), "item_id").limit(k)
           .agg(F.array_join(F.transform(
               F.array_sort(F.collect_list(F.struct(F.when(F.col("urgency") == "critical", 0).otherwise(1)
                                                    .alias("o"), F.col("item_id")))),
               lambda s: s["item_id"].cast("string")), ",")))
    base = ok.agg(F.count(F.lit(1)).alias("total_parts_monitored"), F.avg("mae").alias("_mae"),
                  count_if(F.col("zero_pct") > 90).alias("high_intermittency"))
    acc = F.when(F.col("_mae") < 1, F.lit(1.0) - F.col("_mae")).otherwise(F.lit(0.95))
    return base.select(
        "total_parts_monitored", acc.alias("average_model_accuracy"),
        F.coalesce(risky.agg(count_if(F.col("urgency") == "critical")).scalar(), F.lit(0)).alias("critical_alerts"),
        F.coalesce(top.scalar(), F.lit("")).alias("high_risk_parts"), "high_intermittency")


def model_status(results: DataFrame) -> DataFrame:
    ok = results.where(F.col("status") == "success")
    return ok.select("part_id", F.when(F.col("zero_pct") > 80, "TwoStage").otherwise("XGBoost").alias("model_type"),
                     "mae", "zero_pct")


def results_overview(results: DataFrame, suppliers: DataFrame, lead_stats: DataFrame, zero_profile: DataFrame,
                     k: int = 5) -> DataFrame:
    """One long table (section, metric, detail, value) with the training, supplier,
    lead-time and coverage figures and the k best models."""
    def rows(df, section, cols):
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(section).alias("section"), F.lit(m).alias("metric"),
                     F.lit(None).cast("string").alias("detail"), c.cast("double").alias("value"))
            for m, c in cols])).alias("r")).select("r.*")

    tr = results.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("status") == "success", 1.0).otherwise(0.0)).alias("sr"),
                     F.avg("mae").alias("am"), F.min("mae").alias("bm"), F.avg("zero_pct").alias("az"))
    a = rows(tr, "training", [("total_parts", F.col("n")), ("success_rate", F.col("sr")),
                              ("average_mae", F.col("am")), ("best_mae", F.col("bm")),
                              ("average_zero_pct", F.col("az"))])
    w = Window.orderBy(F.round("mae", 9), "part_id")
    best = (results.where(F.col("mae").isNotNull()).orderBy(F.round("mae", 9), "part_id").limit(k)
            .select(F.lit("best_models").alias("section"),
                    F.concat(F.lit("rank_"), F.row_number().over(w).cast("string")).alias("metric"),
                    F.col("part_id").cast("string").alias("detail"), F.col("mae").alias("value")))
    sp = suppliers.agg(F.count(F.lit(1)).alias("n"), F.avg("avg_lead_time").alias("lt"),
                       F.avg("on_time_rate").alias("ot"))
    b = rows(sp, "suppliers", [("suppliers", F.col("n")), ("average_lead_time", F.col("lt")),
                               ("average_on_time_rate", F.col("ot"))])
    ls = lead_stats.agg(F.count(F.lit(1)).alias("n"), F.avg("lead_time_mean").alias("m"),
                        F.avg("lead_time_p95").alias("p"), F.avg("supplier_reliability").alias("r"))
    c = rows(ls, "lead_time", [("item_supplier_pairs", F.col("n")), ("average_lead_time", F.col("m")),
                               ("average_p95", F.col("p")), ("average_reliability", F.col("r"))])
    z = F.col("zero_pct")
    zp = zero_profile.agg(F.count(F.lit(1)).alias("n"), count_if(z > 90).alias("vh"),
                          count_if((z >= 70) & (z <= 90)).alias("h"), count_if(z < 70).alias("m"))
    d = rows(zp, "coverage", [("parts", F.col("n")), ("very_high_intermittency", F.col("vh")),
                              ("high_intermittency", F.col("h")), ("moderate_intermittency", F.col("m"))])
    return a.unionByName(best).unionByName(b).unionByName(c).unionByName(d)


def pipeline_summary(comparison: DataFrame, k: int = 3) -> DataFrame:
    """Mean candidate / baseline MAE and improvement mean / max / min, plus the
    k best and k worst items by improvement.  The comparison (one row per item)
    feeds three branches, so it is checkpointed once instead of recomputing the
    whole evaluation per branch."""
    from partcast.session import cut_lineage

    comparison = cut_lineage(comparison)
    c = comparison.where(F.col("improvement_pct").isNotNull())
    summ = comparison.agg(
        F.lit("summary").alias("kind"), F.lit(None).cast("string").alias("item_id"),
        F.avg("candidate_mae").alias("candidate_mae"), F.avg("baseline_mae").alias("baseline_mae"),
        F.avg("improvement_pct").alias("improvement_pct"),
        F.max("improvement_pct").alias("max_improvement"), F.min("improvement_pct").alias("min_improvement"))
    # item_id as text: the summary row has none, and a NULL in an integer column
    # converts differently to pandas across engines
    cols = [F.col("item_id").cast("string").alias("item_id"), "candidate_mae", "baseline_mae", "improvement_pct"]
    best = c.orderBy(F.desc("improvement_pct"), "item_id").limit(k).select(F.lit("best").alias("kind"), *cols)
    worst = c.orderBy(F.asc("improvement_pct"), "item_id").limit(k).select(F.lit("worst").alias("kind"), *cols)
    extra = [F.lit(None).cast("double").alias("max_improvement"), F.lit(None).cast("double").alias("min_improvement")]
    return summ.unionByName(best.select("*", *extra)).unionByName(worst.select("*", *extra))


def report_summary(fc: DataFrame, urgency: DataFrame, results: DataFrame) -> DataFrame:
    """Per part: forecast sum and mean, urgency, zero share and model MAE."""
    f = fc.groupBy("item_id").agg(F.sum("predicted_demand").alias("forecast_sum"),
                                  F.avg("predicted_demand").alias("forecast_mean"))
    r = results.select(F.col("part_id").alias("item_id"), "zero_pct", "mae")
    return f.join(urgency.select("item_id", "urgency"), "item_id", "left").join(r, "item_id", "left")


def forecast_summary(rows: DataFrame) -> DataFrame:
    """Horizon days, parts, and critical / warning row counts of an urgency-tagged forecast."""
    return rows.agg(F.countDistinct("ds").cast("bigint").alias("horizon_days"),
                    F.countDistinct("item_id").cast("bigint").alias("total_parts"),
                    count_if(F.col("urgency") == "critical").alias("critical_orders"),
                    count_if(F.col("urgency") == "warning").alias("warning_orders"))


def daily_total(rows: DataFrame, value: str = "consumption") -> DataFrame:
    return rows.groupBy("ds").agg(F.sum(value).alias("total_consumption"))
