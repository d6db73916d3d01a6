"""Registered queries: demand classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from partcast.operators import classify as K
from partcast.operators import reshape as R
from partcast.operators.extract import consumption_lines
from partcast.plans.registry import EP, P, register
from partcast.plans.sqlkit import cte, sql

SOURCES = (("parts", P), ("family", P), ("events_all", EP), ("events_purchase", EP))

cte("fixed_all", "\nUNION ALL\n".join(
    f"SELECT '{s}' AS source, item_id, ds, qty, rn, n FROM {s}_fixed_pos" for s, _ in SOURCES),
    *[f"{s}_fixed_pos" for s, _ in SOURCES])
cte("sbc", """
SELECT *, CASE WHEN cv2 IS NULL THEN 'Lumpy'
               WHEN adi < 1.32 AND cv2 < 0.49 THEN 'Smooth'
               WHEN adi >= 1.32 AND cv2 < 0.49 THEN 'Intermittent'
               WHEN adi < 1.32 AND cv2 >= 0.49 THEN 'Erratic' ELSE 'Lumpy' END AS demand_pattern
FROM (SELECT source, item_id, count(*) AS n_periods, sum(qty) AS total_demand,
             count_if(qty > 0) AS periods_with_demand, count_if(qty = 0) AS periods_without_demand,
             CAST(count_if(qty > 0) AS DOUBLE) / count(*) * 100 AS demand_percentage,
             CASE WHEN count_if(qty > 0) > 1
                  THEN CAST(max(CASE WHEN qty > 0 THEN rn END) - min(CASE WHEN qty > 0 THEN rn END) AS DOUBLE)
                       / (count_if(qty > 0) - 1)
                  ELSE CAST(count(*) AS DOUBLE) END AS adi,
             CASE WHEN count_if(qty > 0) = 0 THEN 0.0
                  WHEN avg(CASE WHEN qty > 0 THEN qty END) > 0
                  THEN pow(stddev_samp(CASE WHEN qty > 0 THEN qty END) / avg(CASE WHEN qty > 0 THEN qty END), 2)
                  ELSE 0.0 END AS cv2,
             COALESCE(avg(CASE WHEN qty > 0 THEN qty END), 0.0) AS mean_demand_when_positive,
             max(qty) AS max_demand
      FROM fixed_all GROUP BY source, item_id) g""", "fixed_all")
cte("parts_zero_pct", """
SELECT item_id, avg(CASE WHEN qty = 0 THEN 1.0 ELSE 0.0 END) * 100 AS zero_pct FROM parts_dense GROUP BY item_id""",
    "parts_dense")


def _sbc_all(t):
    parts = []
    for name, p in SOURCES:
        daily = R.demand_source(t, p, name)
        parts.append(K.sbc_class(daily, p.days_back + 1).withColumn("source", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _dense(t):
    return R.dense_series(t, P, "parts", "own")


@register("sbc_class", sql("SELECT * FROM sbc", "sbc"))
def _sbc_class(t):
    return _sbc_all(t)


@register("pattern_summary", sql("""
SELECT source, demand_pattern, count(*) AS n_items, avg(demand_percentage) AS mean_demand_percentage,
       count_if(demand_percentage < 10) AS items_below_10pct,
       CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY source) * 100 AS pct_items
FROM sbc GROUP BY source, demand_pattern""", "sbc"))
def _pattern_summary(t):
    return K.pattern_summary(_sbc_all(t))


@register("zero_cv_class", sql("""
SELECT *, CASE WHEN zero_percentage < 20 THEN CASE WHEN coefficient_variation < 0.5 THEN 'SMOOTH' ELSE 'ERRATIC' END
               WHEN zero_percentage < 50 THEN CASE WHEN coefficient_variation < 1.0 THEN 'INTERMITTENT'
                                                   ELSE 'LUMPY' END
               ELSE 'VERY_INTERMITTENT' END AS demand_type
FROM (SELECT item_id, count(*) AS total_days, count_if(qty > 0) AS active_days, count_if(qty = 0) AS zero_days,
             avg(qty) AS mean_consumption, stddev_samp(qty) AS std_consumption,
             count_if(z = 1 AND pz = 0) AS zero_runs, max(qty) AS max_consumption,
             quantile_cont(qty, 0.25) AS q25, quantile_cont(qty, 0.5) AS q50, quantile_cont(qty, 0.75) AS q75,
             CAST(count_if(qty = 0) AS DOUBLE) / count(*) * 100 AS zero_percentage,
             CASE WHEN avg(qty) > 0 THEN stddev_samp(qty) / avg(qty) ELSE 'inf'::DOUBLE END AS coefficient_variation,
             CASE WHEN count_if(qty > 0) > 1
                  THEN CAST(max(CASE WHEN qty > 0 THEN ds END) - min(CASE WHEN qty > 0 THEN ds END) AS DOUBLE)
                       / (count_if(qty > 0) - 1)
                  ELSE CAST(count(*) AS DOUBLE) END AS avg_interval_days
      FROM (SELECT *, CASE WHEN qty = 0 THEN 1 ELSE 0 END AS z,
                   lag(CASE WHEN qty = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY ds) AS pz
            FROM parts_dense) x
      GROUP BY item_id) g""", "parts_dense"))
def _zero_cv_class(t):
    return K.zero_cv_class(_dense(t))


@register("volume_class", sql(f"""
SELECT *, CASE WHEN total_demand > 1000 THEN 'high_volume' WHEN demand_frequency > 0.3 THEN 'regular'
               WHEN demand_frequency > 0.1 THEN 'intermittent' ELSE 'very_intermittent' END AS category
FROM (SELECT item_id, sum(qty) AS total_demand, count_if(qty > 0) AS demand_days,
             count_if(qty > 0) / {float(P.days_back + 1)} AS demand_frequency
      FROM parts_fixed GROUP BY item_id) g""", "parts_fixed"))
def _volume_class(t):
    return K.volume_class(R.demand_parts(t, P), P.days_back + 1)


@register("model_route", sql("""
SELECT item_id, zero_pct,
       CASE WHEN zero_pct < 50 THEN 'tweedie_1.3' WHEN zero_pct < 80 THEN 'tweedie_1.7' ELSE 'two_stage' END
         AS model_route,
       CASE WHEN zero_pct < 50 THEN 1.3 WHEN zero_pct < 80 THEN 1.7 END AS tweedie_power
FROM parts_zero_pct""", "parts_zero_pct"))
def _model_route(t):
    return K.model_route(K.zero_percentage(R.demand_parts(t, P)))


cte("pts", "SELECT item_id, count(DISTINCT ds) AS data_points FROM hist_lines GROUP BY item_id", "hist_lines")


def _bucket_sql(spec):
    parts = []
    for label, lo, hi in spec:
        cond = f"data_points >= {lo}" if hi is None else f"data_points BETWEEN {lo} AND {hi}"
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


def _order_sql(spec):
    return "CASE " + " ".join(f"WHEN label = '{lab}' THEN {i}" for i, (lab, _, _) in enumerate(spec)) + " END"


@register("data_tiers", sql(f"""
SELECT kind, label, parts_count,
       CAST(parts_count AS DOUBLE) / sum(parts_count) OVER (PARTITION BY kind) * 100 AS percentage,
       CAST(sum(parts_count) OVER (PARTITION BY kind ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS DOUBLE) / sum(parts_count) OVER (PARTITION BY kind) * 100 AS cumulative_pct
FROM (SELECT kind, label, count(*) AS parts_count,
             CASE WHEN kind = 'range' THEN {_order_sql(K.POINT_RANGES)} ELSE {_order_sql(K.TIERS)} END AS o
      FROM (SELECT 'range' AS kind, {_bucket_sql(K.POINT_RANGES)} AS label FROM pts
            UNION ALL SELECT 'tier' AS kind, {_bucket_sql(K.TIERS)} AS label FROM pts) u
      GROUP BY kind, label) c""", "pts"))
def _data_tiers(t):
    lines = consumption_lines(t, P, None, P.as_of)
    points = lines.groupBy("item_id").agg(F.countDistinct("ds").alias("data_points"))
    return K.data_tiers(points)


@register("zero_bins", sql("""
SELECT zero_bin, count(*) AS parts FROM (
  SELECT CASE WHEN zero_pct > 0 AND zero_pct <= 30 THEN '(0, 30]' WHEN zero_pct > 30 AND zero_pct <= 50 THEN '(30, 50]'
              WHEN zero_pct > 50 AND zero_pct <= 70 THEN '(50, 70]' WHEN zero_pct > 70 AND zero_pct <= 90 THEN '(70, 90]'
              WHEN zero_pct > 90 AND zero_pct <= 100 THEN '(90, 100]' END AS zero_bin
  FROM parts_zero_pct) b WHERE zero_bin IS NOT NULL GROUP BY zero_bin""", "parts_zero_pct"))
def _zero_bins(t):
    return K.zero_bins(K.zero_percentage(R.demand_parts(t, P)))
