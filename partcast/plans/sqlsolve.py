"""Oracle SQL of the per-item autoregressions: normal equations as grouped sums, elimination
and back-substitution spelled out column by column, and the recursion over a fold's days.

Written apart from ``operators.linear``: scalar SQL, one step per common table expression.
"""

from __future__ import annotations

from partcast.operators.linear import CALENDAR, LAGS, RIDGE
from partcast.plans.sqlfeat import cyc, dow
from partcast.plans.sqlkit import cte


def autoregression(name: str, pos: str, cut: str, steps: int, lags=LAGS) -> None:
    """Registers ``{name}``: item_id, part (fold + 1), h, qty, yhat, from the positions CTE
    ``pos`` (item_id, ds, qty, rn, n); ``cut`` is the first cut-off in terms of n."""
    over = "(PARTITION BY item_id ORDER BY ds)"
    cte(f"{name}_scale", f"""
SELECT *, avg(CASE WHEN rn < cut THEN qty END) OVER (PARTITION BY item_id) AS mu,
       stddev_pop(CASE WHEN rn < cut THEN qty END) OVER (PARTITION BY item_id) AS dev
FROM (SELECT *, CAST({cut} AS INTEGER) AS cut FROM {pos}) p""", pos)
    cte(f"{name}_y", f"""
SELECT item_id, ds, qty, rn, cut, mu, CASE WHEN dev > 0 THEN dev ELSE 1.0 END AS sd,
       (qty - mu) / CASE WHEN dev > 0 THEN dev ELSE 1.0 END AS y FROM {name}_scale""", f"{name}_scale")
    names = ["1.0", *(f"lag(y, {k}) OVER {over}" for k in lags), *(cyc(dow(), 7, c.rsplit("_", 1)[1]) for c in CALENDAR)]
    d = len(names)
    cols = ", ".join(f"{e} AS x{i}" for i, e in enumerate(names))
    cte(f"{name}_x", f"""
SELECT *, CASE WHEN rn < cut THEN 0 ELSE CAST(floor((rn - cut) / {float(steps)}) AS INTEGER) + 1 END AS part,
       CASE WHEN rn >= cut THEN (rn - cut) % {steps} + 1 END AS h
FROM (SELECT *, {cols} FROM {name}_y) r WHERE rn >= {max(lags)} AND cut > {max(lags)}""", f"{name}_y")
    sums = {f"a{i}_{j}": f"sum(x{i} * x{j})" for i in range(d) for j in range(i, d)} | {f"a{i}_{d}": f"sum(x{i} * y)" for i in range(d)}
    # the fold's own days, one column per day and feature that was known at the cut-off
    known = {f"q{h}": f"max(CASE WHEN h = {h} AND part > 0 THEN qty END)" for h in range(1, steps + 1)}
    for h in range(1, steps + 1):
        for i in range(1, d):
            if i > len(lags) or lags[i - 1] >= h:
                known[f"v{h}_{i}"] = f"max(CASE WHEN h = {h} AND part > 0 THEN x{i} END)"
    cte(f"{name}_parts", f"SELECT item_id, mu, sd, part, {', '.join(f'{e} AS {c}' for c, e in (sums | known).items())} FROM {name}_x GROUP BY item_id, mu, sd, part", f"{name}_x")
    run = ", ".join(f"sum({c}) OVER w" + (f" + {RIDGE}" if c[1:].split("_")[0] == c[1:].split("_")[1] and c != "a0_0" else "") + f" AS {c}" for c in sums)
    cte(f"{name}_e0", f"""
SELECT item_id, mu, sd, part, {', '.join(known)}, {run} FROM {name}_parts
WINDOW w AS (PARTITION BY item_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", f"{name}_parts")
    carry = f"item_id, mu, sd, part, {', '.join(known)}"
    last = f"{name}_e0"
    for k in range(d):                       # row k leaves the rows below it
        done = [f"a{i}_{j}" for i in range(k + 1) for j in range(i, d + 1)]
        rest = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(k + 1, d) for j in range(i, d + 1)]
        cte(f"{name}_e{k + 1}", f"SELECT {carry}, {', '.join(done + rest)} FROM {last}{' WHERE part > 0' if not k else ''}", last)
        last = f"{name}_e{k + 1}"
    for i in reversed(range(d)):
        minus = "".join(f" - a{i}_{j} * b{j}" for j in range(i + 1, d))
        cte(f"{name}_b{i}", f"SELECT *, (a{i}_{d}{minus}) / a{i}_{i} AS b{i} FROM {last}", last)
        last = f"{name}_b{i}"
    for h in range(1, steps + 1):
        terms = ["b0"]
        for i in range(1, d):
            own = i <= len(lags) and lags[i - 1] < h
            terms.append(f"b{i} * {f'f{h - lags[i - 1]}' if own else f'v{h}_{i}'}")
        cte(f"{name}_f{h}", f"SELECT *, {' + '.join(terms)} AS f{h} FROM {last}", last)
        last = f"{name}_f{h}"
    cte(name, "\nUNION ALL\n".join(
        f"SELECT item_id, part, {h} AS h, q{h} AS qty, greatest(f{h} * sd + mu, 0.0) AS yhat FROM {last} WHERE q{h} IS NOT NULL" for h in range(1, steps + 1)), last)
