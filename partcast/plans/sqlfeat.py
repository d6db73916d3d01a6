"""DuckDB SQL expression builders for the calendar and window-feature oracles."""

from __future__ import annotations

import datetime as dt

W = "PARTITION BY item_id ORDER BY ds"


def fr(k: int) -> str:
    return f"({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


UPTO = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AFTER = f"({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


def dow(ds="ds"):
    return f"(isodow({ds}) - 1)"


def cyc(v: str, period: int, fn: str) -> str:
    return f"{fn}(2 * pi() * {v} / {period}.0)"


def basic(ds="ds"):
    return (f"{dow(ds)} AS day_of_week, day({ds}) AS day_of_month, weekofyear({ds}) AS week_of_year, "
            f"month({ds}) AS month, quarter({ds}) AS quarter, year({ds}) AS year, "
            f"CASE WHEN {dow(ds)} >= 5 THEN 1 ELSE 0 END AS is_weekend")


def cyclic(ds="ds"):
    d, m, w = dow(ds), f"month({ds})", f"weekofyear({ds})"
    return (f"{cyc(d, 7, 'sin')} AS day_sin, {cyc(d, 7, 'cos')} AS day_cos, "
            f"{cyc(m, 12, 'sin')} AS month_sin, {cyc(m, 12, 'cos')} AS month_cos, "
            f"{cyc(w, 52, 'sin')} AS week_sin, {cyc(w, 52, 'cos')} AS week_cos")


def holiday(holidays: tuple[dt.date, ...], ds="ds"):
    lst = "[" + ", ".join(f"DATE '{h.isoformat()}'" for h in holidays) + "]"
    diffs = f"list_transform({lst}, lambda h: {ds} - h)"
    since = f"list_min(list_filter({diffs}, lambda x: x >= 0))"
    until = f"list_min(list_transform(list_filter({diffs}, lambda x: x < 0), lambda x: -x))"
    return (f"CASE WHEN list_contains({lst}, {ds}) THEN 1 ELSE 0 END AS is_holiday, "
            f"least(COALESCE({until}, 999), 30) AS days_to_holiday, "
            f"least(COALESCE({since}, 999), 30) AS days_from_holiday")


def bday_of_month(ds="ds"):
    return (f"len(list_filter(generate_series(date_trunc('month', {ds}), CAST({ds} AS TIMESTAMP), "
            f"INTERVAL 1 DAY), lambda x: isodow(x) < 6))")


def bday_flags(ds="ds"):
    d, m = dow(ds), f"month({ds})"
    mend = f"({ds} = last_day({ds}))"
    mstart = f"(day({ds}) = 1)"
    return (f"CASE WHEN {d} = 0 THEN 1 ELSE 0 END AS is_monday, "
            f"CASE WHEN {d} = 4 THEN 1 ELSE 0 END AS is_friday, "
            f"CASE WHEN {d} >= 5 THEN 1 ELSE 0 END AS is_weekend, "
            f"CASE WHEN {mstart} THEN 1 ELSE 0 END AS is_month_start, "
            f"CASE WHEN {mend} THEN 1 ELSE 0 END AS is_month_end, "
            f"CASE WHEN {mstart} AND {m} IN (1, 4, 7, 10) THEN 1 ELSE 0 END AS is_quarter_start, "
            f"CASE WHEN {mend} AND {m} IN (3, 6, 9, 12) THEN 1 ELSE 0 END AS is_quarter_end")


def weekend_distance(ds="ds"):
    d = dow(ds)
    return (f"CASE WHEN {d} >= 5 THEN 0 ELSE {d} + 1 END AS days_since_weekend, "
            f"CASE WHEN {d} >= 5 THEN 0 ELSE 5 - {d} END AS days_until_weekend")


def business(ds="ds"):
    d, m = dow(ds), f"month({ds})"
    mend = f"({ds} = last_day({ds}))"
    mstart = f"(day({ds}) = 1)"
    return ", ".join([
        f"{d} AS day_of_week",
        f"CASE WHEN {d} = 0 THEN 1 ELSE 0 END AS is_monday",
        f"CASE WHEN {d} = 4 THEN 1 ELSE 0 END AS is_friday",
        f"CASE WHEN {d} >= 5 THEN 1 ELSE 0 END AS is_weekend",
        f"{bday_of_month(ds)} AS business_day_of_month",
        weekend_distance(ds),
        f"{m} AS month", f"quarter({ds}) AS quarter",
        f"CASE WHEN {mstart} THEN 1 ELSE 0 END AS is_month_start",
        f"CASE WHEN {mend} THEN 1 ELSE 0 END AS is_month_end",
        f"CASE WHEN {mstart} AND {m} IN (1, 4, 7, 10) THEN 1 ELSE 0 END AS is_quarter_start",
        f"CASE WHEN {mend} AND {m} IN (3, 6, 9, 12) THEN 1 ELSE 0 END AS is_quarter_end",
        f"{cyc(d, 7, 'sin')} AS day_sin", f"{cyc(d, 7, 'cos')} AS day_cos",
        f"{cyc(m, 12, 'sin')} AS month_sin", f"{cyc(m, 12, 'cos')} AS month_cos",
    ])


def lags(q="qty"):
    out = []
    for k in (1, 7, 14, 30):
        out.append(f"lag({q}, {k}) OVER ({W}) AS lag_{k}")
        out.append(f"CASE WHEN lag({q}, {k}) OVER ({W}) > 0 THEN 1 ELSE 0 END AS had_demand_lag_{k}")
    return ", ".join(out)


def rolling(q="qty", stats=True, counts=True):
    out = []
    for k in (7, 14, 30):
        f = fr(k)
        if stats:
            out += [f"avg({q}) OVER {f} AS rolling_mean_{k}", f"stddev_samp({q}) OVER {f} AS rolling_std_{k}",
                    f"max({q}) OVER {f} AS rolling_max_{k}", f"min({q}) OVER {f} AS rolling_min_{k}"]
        if counts:
            zc = f"sum(CASE WHEN {q} = 0 THEN 1 ELSE 0 END) OVER {f}"
            out += [f"{zc} AS rolling_zero_count_{k}",
                    f"sum(CASE WHEN {q} > 0 THEN 1 ELSE 0 END) OVER {f} AS rolling_nonzero_count_{k}",
                    f"{zc} / {k}.0 AS intermittency_ratio_{k}"]
    return ", ".join(out)


def since(q="qty"):
    return f"COALESCE(rn - last_value(CASE WHEN {q} > 0 THEN rn END IGNORE NULLS) OVER {UPTO}, 0)"


def until(q="qty"):
    return f"COALESCE(first_value(CASE WHEN {q} > 0 THEN rn END IGNORE NULLS) OVER {AFTER} - rn, 30)"


def runs(q="qty"):
    z = f"rn - COALESCE(last_value(CASE WHEN {q} <> 0 THEN rn END IGNORE NULLS) OVER {UPTO}, -1)"
    d = f"rn - COALESCE(last_value(CASE WHEN {q} <= 0 THEN rn END IGNORE NULLS) OVER {UPTO}, -1)"
    return f"{z} AS zero_run_length, {d} AS demand_run_length"


def gini(q: str, k: int) -> str:
    f = fr(k)
    arr = f"list_sort(list({q}) OVER {f})"
    s = f"sum({q}) OVER {f}"
    n = f"CAST(count(*) OVER {f} AS DOUBLE)"
    weighted = f"list_sum(list_transform({arr}, lambda x, i: x * i))"
    return f"CASE WHEN {s} = 0 THEN 0.0 ELSE 2.0 * {weighted} / ({n} * {s}) - ({n} + 1) / {n} END"


def probs(q="qty"):
    pos = f"CASE WHEN {q} > 0 THEN 1.0 ELSE 0.0 END"
    return f"avg({pos}) OVER {fr(7)} AS demand_probability_7d, avg({pos}) OVER {fr(30)} AS demand_probability_30d"
