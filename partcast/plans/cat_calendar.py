"""Registered queries: calendar and business-day features."""

from __future__ import annotations

from partcast.operators import features as Fe
from partcast.operators import reshape as R
from partcast.plans import sqlfeat as S
from partcast.plans.registry import P, register
from partcast.plans.sqlkit import sql


def _dense(t):
    return R.dense_series(t, P, "parts", "own")


@register("calendar_basic", sql(f"SELECT item_id, ds, qty, {S.basic()} FROM parts_dense", "parts_dense"))
def _calendar_basic(t):
    return Fe.calendar_basic(_dense(t))


@register("calendar_cyclic", sql(f"SELECT item_id, ds, qty, {S.cyclic()} FROM parts_dense", "parts_dense"))
def _calendar_cyclic(t):
    return Fe.calendar_cyclic(_dense(t))


@register("calendar_holiday", sql(f"SELECT item_id, ds, qty, {S.holiday(P.holidays)} FROM parts_dense",
                                  "parts_dense"))
def _calendar_holiday(t):
    return Fe.calendar_holiday(_dense(t), P.holidays)


@register("calendar_exog", sql(f"""
SELECT ds, {S.basic()}, {S.cyclic()}, {S.holiday(P.holidays)}
FROM (SELECT CAST(unnest(generate_series(min(ds), max(ds) + {P.horizon}, INTERVAL 1 DAY)) AS DATE) AS ds
      FROM parts_dense) d""", "parts_dense"))
def _calendar_exog(t):
    return Fe.calendar_exog(_dense(t), P.horizon, P.holidays)


@register("bday_flags", sql(f"SELECT item_id, ds, qty, {S.bday_flags()} FROM parts_dense", "parts_dense"))
def _bday_flags(t):
    return Fe.bday_flags(_dense(t))


@register("bday_of_month", sql(f"SELECT item_id, ds, qty, {S.bday_of_month()} AS business_day_of_month "
                               f"FROM parts_dense", "parts_dense"))
def _bday_of_month(t):
    return Fe.bday_of_month(_dense(t))


@register("weekend_distance", sql(f"SELECT item_id, ds, qty, {S.weekend_distance()} FROM parts_dense",
                                  "parts_dense"))
def _weekend_distance(t):
    return Fe.weekend_distance(_dense(t))
