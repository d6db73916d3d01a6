"""Registered queries: baseline and intermittent forecasters."""

from __future__ import annotations

from partcast.operators import baselines as B
from partcast.operators import reshape as R
from partcast.operators.extract import window_start
from partcast.plans.registry import P, register
from partcast.plans.sqlkit import cte, sql

H = P.horizon
A, CA = P.ses_alpha, P.croston_alpha
BA, CB = 1 - A, 1 - CA
SBA_F = 1 - CA / 2
W = "PARTITION BY item_id ORDER BY ds"

def forecast_ctes(prefix: str, series: str, holdout: bool = True, share: float | None = None) -> None:
    """Register {prefix}_train / _test / _ann / _raw / _const over a dense
    series CTE with (item_id, ds, qty, rn, n); without hold-out the whole
    series is the training set; with ``share`` the first floor(share * n) rows are."""
    if share is not None:
        cte(f"{prefix}_train", f"""
SELECT item_id, ds, qty, rn, CAST(floor(n * {share}) AS INTEGER) AS n FROM {series} WHERE rn < floor(n * {share})""",
            series)
    elif holdout:
        cte(f"{prefix}_train", f"""
SELECT item_id, ds, qty, rn, n - {H} AS n FROM {series} WHERE rn < n - {H} AND n - {H} >= {P.min_train}""",
            series)
    else:
        cte(f"{prefix}_train", f"SELECT item_id, ds, qty, rn, n FROM {series}", series)
    cte(f"{prefix}_test", f"""
SELECT item_id, ds, qty FROM {series} WHERE rn >= n - {H} AND n - {H} >= {P.min_train}""", series)
    cte(f"{prefix}_ann", f"""
SELECT *, count_if(qty > 0) OVER (PARTITION BY item_id) AS k,
       CASE WHEN qty > 0 THEN sum(CASE WHEN qty > 0 THEN 1 ELSE 0 END)
            OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS pr,
       CASE WHEN qty > 0 THEN rn - COALESCE(last_value(CASE WHEN qty > 0 THEN rn END IGNORE NULLS)
            OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) END AS gap
FROM {prefix}_train""", f"{prefix}_train")
    season = ", ".join(f"max(CASE WHEN rn = n - {8 - j} THEN qty END) AS s{j}" for j in range(1, 8))
    cte(f"{prefix}_raw", f"""
SELECT item_id, max(ds) AS train_end, max(n) AS n, max(k) AS k,
       avg(CASE WHEN rn >= n - 7 THEN qty END) AS MA_7, avg(CASE WHEN rn >= n - 14 THEN qty END) AS MA_14,
       avg(CASE WHEN rn >= n - 30 THEN qty END) AS MA_30,
       CASE WHEN max(n) >= 7 THEN sum(CASE WHEN rn >= n - 7 THEN qty * (rn - n + 8) END) / 28.0 END AS WMA_7,
       max(CASE WHEN rn = n - 1 THEN qty END) AS Naive, {season},
       COALESCE(sum(CASE WHEN rn <= n - 2 THEN {A!r} * pow({BA!r}, n - 2 - rn) * qty END), 0.0)
         + pow({BA!r}, max(n) - 1) * max(CASE WHEN rn = 0 THEN qty END) AS ExpSmooth,
       sum(sw * qty) AS z, sum(sw * gap) AS p, max(CASE WHEN pr = 1 THEN rn END) AS t1,
       sum(CASE WHEN qty > 0 THEN {CA!r} * pow({CB!r}, n - 1 - rn) END) AS pos_w,
       avg(CASE WHEN pr > k - 3 THEN qty END) AS last3, avg(qty) AS Mean
FROM (SELECT *, CASE WHEN pr = 1 THEN pow({CB!r}, k - 1) WHEN pr >= 2 THEN {CA!r} * pow({CB!r}, k - pr) END AS sw
      FROM {prefix}_ann) a
GROUP BY item_id""", f"{prefix}_ann")
    cte(f"{prefix}_const", f"""
SELECT *, Croston * {SBA_F!r} AS SBA,
       CASE WHEN k = 0 THEN 0.0
            ELSE greatest((pow({CB!r}, n) / (t1 + 1) + COALESCE(pos_w, 0.0)) * z, 0.0) END AS TSB,
       CASE WHEN k = 0 THEN 0.0 ELSE last3 * k / n END AS MA_NonZero
FROM (SELECT *, CASE WHEN k = 0 THEN 0.0 WHEN p > 0 THEN z / p ELSE 0.0 END AS Croston FROM {prefix}_raw) c""",
        f"{prefix}_raw")


forecast_ctes("fc", "parts_fixed_pos")
forecast_ctes("fco", "parts_dense_pos")
forecast_ctes("fut", "parts_fixed_pos", holdout=False)
forecast_ctes("bsel", "parts_fixed_pos", share=0.8)


def _season_expr() -> str:
    return "CASE " + " ".join(f"WHEN h = {j} THEN s{j}" for j in range(1, 8)) + " ELSE Naive END"


def long_body(methods, prefix: str = "fc") -> str:
    parts = []
    for m in methods:
        expr = _season_expr() if m == "Seasonal_7" else m
        parts.append(f"SELECT item_id, '{m}' AS method, h, CAST(train_end + CAST(h AS INTEGER) AS DATE) AS ds, "
                     f"CAST({expr} AS DOUBLE) AS yhat FROM {prefix}_const, generate_series(1, {H}) AS g(h)")
    return "\nUNION ALL\n".join(parts)


def long_sql(methods) -> str:
    return sql(long_body(methods), "fc_const")


cte("fc_all", long_body(B.METHODS), "fc_const")
cte("fco_all", long_body(B.METHODS, "fco"), "fco_const")


def _fc(t, methods):
    # closed forms need only the non-empty days: run on the sparse daily sums
    return B.forecasts(R.demand_parts(t, P), P, methods, window_start(P), P.as_of)


def _reg(key: str, methods) -> None:
    @register(key, long_sql(methods))
    def _q(t):
        return _fc(t, methods)


_reg("fc_moving_average", ("MA_7", "MA_14", "MA_30"))
_reg("fc_wma", ("WMA_7",))
_reg("fc_naive", ("Naive",))
_reg("fc_seasonal_naive", ("Seasonal_7",))
_reg("fc_exp_smoothing", ("ExpSmooth",))
_reg("fc_croston", ("Croston",))
_reg("fc_sba", ("SBA",))
_reg("fc_tsb", ("TSB",))
_reg("fc_ma_nonzero", ("MA_NonZero",))
_reg("fc_mean", ("Mean",))


@register("fc_same_weekday", sql(f"""
SELECT item_id, ds, qty,
       CASE WHEN rn >= 28 THEN (lag(qty, 7) OVER ({W}) + lag(qty, 14) OVER ({W}) + lag(qty, 21) OVER ({W})
                                + lag(qty, 28) OVER ({W})) / 4.0 END AS fitted
FROM parts_fixed_pos""", "parts_fixed_pos"))
def _fc_same_weekday(t):
    return B.same_weekday_fitted(R.dense_series(t, P, "parts", "fixed"))


_RULES = B.SELECT_RULES


@register("baseline_select", sql(f"""
SELECT c.item_id, c.zero_pct, c.selected_method, c.yhat, v.validation_mae
FROM (SELECT k.item_id, z.zero_pct,
             CASE WHEN z.zero_pct < {_RULES[0][0]} THEN '{_RULES[0][1]}' WHEN z.zero_pct < {_RULES[1][0]} THEN '{_RULES[1][1]}'
                  WHEN z.zero_pct < {_RULES[2][0]} THEN '{_RULES[2][1]}' ELSE 'Ensemble' END AS selected_method,
             CASE WHEN z.zero_pct < {_RULES[0][0]} THEN k.MA_7 WHEN z.zero_pct < {_RULES[1][0]} THEN k.Croston
                  WHEN z.zero_pct < {_RULES[2][0]} THEN k.SBA ELSE (k.MA_7 + k.Croston + k.SBA) / 3.0 END AS yhat
      FROM bsel_const k
      JOIN (SELECT item_id, avg(CASE WHEN qty = 0 THEN 1.0 ELSE 0.0 END) * 100 AS zero_pct FROM bsel_train
            GROUP BY item_id) z ON k.item_id = z.item_id) c
LEFT JOIN (SELECT s.item_id, avg(abs(s.qty - y.yhat)) AS validation_mae
           FROM parts_fixed_pos s JOIN (
             SELECT k.item_id, CASE WHEN z.zero_pct < {_RULES[0][0]} THEN k.MA_7 WHEN z.zero_pct < {_RULES[1][0]} THEN k.Croston
                                    WHEN z.zero_pct < {_RULES[2][0]} THEN k.SBA ELSE (k.MA_7 + k.Croston + k.SBA) / 3.0 END AS yhat
             FROM bsel_const k JOIN (SELECT item_id, avg(CASE WHEN qty = 0 THEN 1.0 ELSE 0.0 END) * 100 AS zero_pct
                                     FROM bsel_train GROUP BY item_id) z ON k.item_id = z.item_id) y
             ON s.item_id = y.item_id
           WHERE s.rn >= floor(s.n * 0.8) GROUP BY s.item_id) v ON c.item_id = v.item_id""",
    "bsel_const", "bsel_train", "parts_fixed_pos"))
def _baseline_select(t):
    return B.baseline_select(R.dense_series(t, P, "parts", "fixed"), P)
