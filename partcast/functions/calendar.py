"""Calendar column expressions (scalar, codegen-friendly, no joins)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def dow(ds: Column) -> Column:
    """Day of week, Monday = 0."""
    return F.weekday(ds)


def cyc(value: Column, period: int, fn=F.sin) -> Column:
    return fn(F.lit(TWO_PI) * value / F.lit(float(period)))


def basic(ds: Column) -> dict[str, Column]:
    d = dow(ds)
    return {
        "day_of_week": d,
        "day_of_month": F.dayofmonth(ds),
        "week_of_year": F.weekofyear(ds),
        "month": F.month(ds),
        "quarter": F.quarter(ds),
        "year": F.year(ds),
        "is_weekend": F.when(d >= 5, 1).otherwise(0),
    }


def cyclic(ds: Column) -> dict[str, Column]:
    d, m, w = dow(ds), F.month(ds), F.weekofyear(ds)
    return {
        "day_sin": cyc(d, 7, F.sin), "day_cos": cyc(d, 7, F.cos),
        "month_sin": cyc(m, 12, F.sin), "month_cos": cyc(m, 12, F.cos),
        "week_sin": cyc(w, 52, F.sin), "week_cos": cyc(w, 52, F.cos),
    }


def holiday(ds: Column, before: Column, after: Column, default: int = 999, cap: int = 30) -> dict[str, Column]:
    """is_holiday, days_to_holiday and days_from_holiday from the latest holiday on or
    before a day and the first after it; none -> ``default``, then capped at ``cap``."""
    return {
        "is_holiday": F.when(before == ds, 1).otherwise(0),
        "days_to_holiday": F.least(F.coalesce(F.datediff(after, ds), F.lit(default)), F.lit(cap)),
        "days_from_holiday": F.least(F.coalesce(F.datediff(ds, before), F.lit(default)), F.lit(cap)),
    }


def business_day_of_month(ds: Column) -> Column:
    """Mon-Fri days from the 1st of the month up to and including ``ds``, in
    closed form: 5 per full week plus the weekdays among the remaining
    ``day % 7`` days that start on the weekday of the 1st (no per-row arrays)."""
    day = F.dayofmonth(ds)
    first_dow = F.weekday(F.trunc(ds, "month"))
    rest = day % 7
    extra = sum(F.when((F.lit(j) < rest) & (((first_dow + j) % 7) < 5), 1).otherwise(0) for j in range(7))
    return (F.floor(day / 7) * 5 + extra).cast("int")


def bday_flags(ds: Column) -> dict[str, Column]:
    d, m = dow(ds), F.month(ds)
    month_end = ds == F.last_day(ds)
    month_start = F.dayofmonth(ds) == 1
    return {
        "is_monday": F.when(d == 0, 1).otherwise(0),
        "is_friday": F.when(d == 4, 1).otherwise(0),
        "is_weekend": F.when(d >= 5, 1).otherwise(0),
        "is_month_start": F.when(month_start, 1).otherwise(0),
        "is_month_end": F.when(month_end, 1).otherwise(0),
        "is_quarter_start": F.when(month_start & m.isin(1, 4, 7, 10), 1).otherwise(0),
        "is_quarter_end": F.when(month_end & m.isin(3, 6, 9, 12), 1).otherwise(0),
    }


def weekend_distance(ds: Column) -> dict[str, Column]:
    d = dow(ds)
    return {
        "days_since_weekend": F.when(d >= 5, 0).otherwise(d + 1),
        "days_until_weekend": F.when(d >= 5, 0).otherwise(5 - d),
    }


def business_features(ds: Column) -> dict[str, Column]:
    """The 17 business-day columns of the full feature set, in order."""
    d, m = dow(ds), F.month(ds)
    flags = bday_flags(ds)
    dist = weekend_distance(ds)
    return {
        "day_of_week": d,
        "is_monday": flags["is_monday"], "is_friday": flags["is_friday"], "is_weekend": flags["is_weekend"],
        "business_day_of_month": business_day_of_month(ds),
        "days_since_weekend": dist["days_since_weekend"], "days_until_weekend": dist["days_until_weekend"],
        "month": m, "quarter": F.quarter(ds),
        "is_month_start": flags["is_month_start"], "is_month_end": flags["is_month_end"],
        "is_quarter_start": flags["is_quarter_start"], "is_quarter_end": flags["is_quarter_end"],
        "day_sin": cyc(d, 7, F.sin), "day_cos": cyc(d, 7, F.cos),
        "month_sin": cyc(m, 12, F.sin), "month_cos": cyc(m, 12, F.cos),
    }
