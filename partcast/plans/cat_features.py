"""Registered queries: lag, rolling and intermittent-demand features."""

from __future__ import annotations

from partcast.operators import features as Fe
from partcast.operators import reshape as R
from partcast.plans import sqlfeat as S
from partcast.plans.registry import P, register
from partcast.plans.sqlkit import sql

BASE = "parts_dense_pos"


def _dense(t):
    return R.dense_series(t, P, "parts", "own")


@register("lags", sql(f"SELECT item_id, ds, qty, {S.lags()} FROM {BASE}", BASE))
def _lags(t):
    return Fe.lags(_dense(t))


@register("rolling_stats", sql(f"SELECT item_id, ds, qty, {S.rolling(counts=False)} FROM {BASE}", BASE))
def _rolling_stats(t):
    return Fe.rolling_stats(_dense(t))


@register("rolling_counts", sql(f"SELECT item_id, ds, qty, {S.rolling(stats=False)} FROM {BASE}", BASE))
def _rolling_counts(t):
    return Fe.rolling_counts(_dense(t))


@register("time_since_demand", sql(f"SELECT item_id, ds, qty, {S.since()} AS time_since_last_demand FROM {BASE}",
                                   BASE))
def _time_since(t):
    return Fe.time_since_demand(_dense(t))


@register("time_until_demand", sql(f"SELECT item_id, ds, qty, {S.until()} AS time_until_next_demand FROM {BASE}",
                                   BASE))
def _time_until(t):
    return Fe.time_until_demand(_dense(t))


@register("run_lengths", sql(f"SELECT item_id, ds, qty, {S.runs()} FROM {BASE}", BASE))
def _run_lengths(t):
    return Fe.run_lengths(_dense(t))


@register("concentration", sql(f"""
SELECT item_id, ds, qty, {S.gini('qty', 7)} AS demand_concentration_7d,
       {S.gini('qty', 30)} AS demand_concentration_30d FROM {BASE}""", BASE))
def _concentration(t):
    return Fe.concentration(_dense(t))


@register("demand_prob", sql(f"""
SELECT item_id, ds, qty, time_since_last_demand, demand_probability_7d, demand_probability_30d,
       avg(time_since_last_demand) OVER {S.fr(30)} AS avg_demand_interval_30d
FROM (SELECT item_id, ds, qty, {S.since()} AS time_since_last_demand, {S.probs()} FROM {BASE}) x""", BASE))
def _demand_prob(t):
    return Fe.demand_prob(_dense(t))


@register("all_features", sql(f"""
SELECT * EXCLUDE (rn, n), avg(time_since_last_demand) OVER {S.fr(30)} AS avg_demand_interval_30d,
       {S.probs()}, {S.business()}
FROM (SELECT *, {S.lags()}, {S.rolling()}, {S.since()} AS time_since_last_demand,
             {S.until()} AS time_until_next_demand, {S.runs()},
             {S.gini('qty', 7)} AS demand_concentration_7d, {S.gini('qty', 30)} AS demand_concentration_30d
      FROM {BASE}) x""", BASE))
def _all_features(t):
    return Fe.all_features(_dense(t))


@register("light_features", sql(f"""
SELECT item_id, ds, qty, {S.dow()} AS dayofweek, day(ds) AS day, weekofyear(ds) AS week, month(ds) AS month,
       {S.cyc(S.dow(), 7, 'sin')} AS dayofweek_sin, {S.cyc(S.dow(), 7, 'cos')} AS dayofweek_cos,
       {S.cyc('month(ds)', 12, 'sin')} AS month_sin, {S.cyc('month(ds)', 12, 'cos')} AS month_cos,
       avg(qty) OVER {S.fr(7)} AS rolling_mean_7, COALESCE(stddev_samp(qty) OVER {S.fr(7)}, 0.0) AS rolling_std_7,
       avg(qty) OVER {S.fr(30)} AS rolling_mean_30
FROM parts_dense""", "parts_dense"))
def _light_features(t):
    return Fe.light_features(_dense(t))
