"""Per-item autoregressions from sufficient statistics (SURVEY 2.9: per-part models and the
refit back-test).

A least-squares model needs of its rows only X'X and X'y.  They are summed per item and interval
between cut-offs; running sums over an item's intervals are the normal equations of every
expanding window, so each fold is solved without reading its history again.  The intervals' own
days are the folds' test days: neither jobs nor passes grow with the folds or the items.

An item's days with demand come together, as narrow rows (no features, no sums, no days without
demand); all that follows is done in blocks of whole items, vectorised over the items and folds
of a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partcast.operators.reshape import spread

#: Days back that a day's demand is regressed on, and the calendar columns beside them.
LAGS = (1, 2, 3, 4, 5, 6, 7, 14, 28)
CALENDAR = ("day_sin", "day_cos")
#: Weight of the squared coefficients (but the intercept's), in units of scaled rows.
RIDGE = 1.0
#: Forecasts enter percentage errors in units of 1 / GRAIN: a day without demand divides by
#: 1e-8, which would show their last bits.
GRAIN = 1e6
#: Days in a block of whole items.
ROWS = 20_000


def feature_names(lags=LAGS) -> list[str]:
    return ["intercept", *(f"lag_{k}" for k in lags), *CALENDAR]


def series(dense: DataFrame, first_cut: Column, lags=LAGS) -> DataFrame:
    """The days with demand (or with an unknown one) of the items whose first cut-off leaves rows
    with a full lag history, each item's together, beside its number of days ``n``, its ``first``
    and last day and its ``cut``; an item without any has one row.  ``first_cut`` is the row number
    of an item's first cut-off, in terms of ``n``.  The days without demand are not sent on: they
    are the other days from the first to the last.  Items and days meet where the days lie."""
    lying = spread(dense.where(F.col("item_id").isNotNull()))
    items = lying.groupBy("item_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("ds").alias("first"), F.max("ds").alias("last"))
    items = items.withColumn("cut", first_cut.cast("int")).where(F.col("cut") > max(lags))
    days = lying.where(F.col("qty").isNull() | (F.col("qty") != 0)).select("item_id", "ds", F.col("qty").cast("double").alias("qty"))
    return items.join(days.hint("merge"), "item_id", "left").sortWithinPartitions("item_id")


def _cells(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def _blocks(batches):
    """Rows of whole items, as tables of items that have ``ROWS`` days together (or one item)."""
    import numpy as np
    import pyarrow as pa

    kept = []

    def cut_up(table, last: bool):
        codes = table["item_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        begin = np.flatnonzero(np.diff(codes, prepend=-1))
        before = np.cumsum(n := table["n"].to_numpy()[begin]) - n
        at = [*begin[np.flatnonzero(np.diff(before // ROWS, prepend=-1))], len(table)]
        whole = len(at) - 1 if last else len(at) - 2           # the last item may go on
        return [table.slice(lo, hi - lo).combine_chunks() for lo, hi in zip(at[:whole], at[1:])], table.slice(at[whole])

    for batch in batches:
        if len(batch):
            ready, rest = cut_up(pa.Table.from_batches([*kept, batch]), False)
            yield from ready
            kept = rest.combine_chunks().to_batches()
    if kept:
        yield from cut_up(pa.Table.from_batches(kept), True)[0]


def solved(rows: DataFrame, steps: int, lags=LAGS, ridge: float = RIDGE) -> DataFrame:
    """item_id, fold, coef, and ``days``: (h, ds, qty, yhat) of each day of the fold, rolled
    forward from the cut-off (a day's lags that lie in the fold are forecasts).

    X'X and X'y are added up per item and interval between cut-offs, for all items of a block at
    once; running sums of them are the normal equations of every fold.  Demand is scaled by the
    mean and deviation of the days before the first cut-off, so no later day is looked at.  A
    product with a missing demand counts in no sum."""
    d, cells, far = len(feature_names(lags)), _cells(len(feature_names(lags))), max(lags)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        upper = tuple(np.array(cells).T)
        day = pa.struct([("h", pa.int32()), ("ds", pa.date32()), ("qty", pa.float64()), ("yhat", pa.float64())])
        for table in _blocks(batches):
            col = {n: table[n].chunk(0) for n in table.column_names}
            codes = col["item_id"].dictionary_encode().indices.to_numpy()
            top = np.flatnonzero(np.diff(codes, prepend=-1))
            days = lambda c: col[c].cast(pa.int32()).fill_null(0).to_numpy()
            n, first, cut = col["n"].to_numpy()[top], days("first")[top], col["cut"].to_numpy()[top]
            if (days("last")[top] - first + 1 != n).any():
                raise ValueError("a series with a day missing or repeated")
            # every day of the items, filled in
            begin = np.cumsum(n) - n
            own = np.repeat(np.arange(len(n)), n)
            rn = np.arange(len(own)) - begin[own]
            cut, date = cut[own], (first[own] + rn).astype(np.int32)
            seen, qty = np.ones(len(own), bool), np.zeros(len(own))
            has = np.flatnonzero(col["ds"].is_valid())
            at = begin[codes[has]] + days("ds")[has] - first[codes[has]]
            seen[at], qty[at] = np.asarray(col["qty"].is_valid())[has], col["qty"].fill_null(0.0).to_numpy()[has]
            before = seen & (rn < cut)
            n = np.add.reduceat(before, begin, dtype=float)      # of the days that are known
            with np.errstate(divide="ignore", invalid="ignore"):
                mu = np.add.reduceat(np.where(before, qty, 0.0), begin) / n
                sd = np.sqrt(np.add.reduceat(np.where(before, (qty - mu[own]) ** 2, 0.0), begin) / n)
            low, high = (f.reduceat(np.where(before, qty, other), begin) for f, other in ((np.minimum, np.inf), (np.maximum, -np.inf)))
            sd = np.where((sd > 0) & (low != high), sd, np.where(np.isnan(sd) & (n > 0), np.nan, 1.0))
            known = seen & (n > 0)[own]
            y = np.where(known, (qty - np.where(n > 0, mu, 0.0)[own]) / sd[own], 0.0)
            # rows with a full lag history, their features, and which of those are known
            at = np.flatnonzero(rn >= far)
            x, there = np.ones((len(at), d)), None if known.all() else np.ones((len(at), d), bool)
            for i, k in enumerate(lags):
                x[:, i + 1] = y[at - k]
                if there is not None:
                    there[:, i + 1] = known[at - k]
            for i, wave in enumerate((np.sin, np.cos)):           # CALENDAR
                x[:, len(lags) + 1 + i] = wave(2 * np.pi * np.arange(7) / 7)[(date[at] + 3) % 7]
            part = np.where(rn < cut, 0, (rn - cut) // steps + 1)[at]
            groups = np.flatnonzero((np.diff(own[at], prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
            wide, target = np.ascontiguousarray(x.T), y[at]
            pairs = [*((wide[i], wide[j]) for i, j in cells), *((wide[i], target) for i in range(d))]
            if there is None:
                sums, found = np.stack([np.add.reduceat(a * b, groups) for a, b in pairs], axis=1), None
            else:
                wide, target = np.ascontiguousarray(there.T), known[at]
                both = [*((wide[i] & wide[j]) for i, j in cells), *((wide[i] & target) for i in range(d))]
                sums = np.stack([np.add.reduceat(np.where(ok, a * b, 0.0), groups) for (a, b), ok in zip(pairs, both)], axis=1)
                found = np.stack([np.add.reduceat(ok, groups, dtype=np.int64) for ok in both], axis=1)
            which, item = part[groups], own[at][groups]
            total, some = np.zeros_like(sums), None if found is None else np.zeros_like(found)
            for p in range(1, which.max(initial=0) + 1):          # an interval follows the one before
                here = np.flatnonzero(which == p)
                total[here] = total[here - 1] + sums[here - 1]
                if found is not None:
                    some[here] = some[here - 1] + found[here - 1]
            if found is not None:
                total = np.where(some > 0, total, np.nan)
            fold = np.flatnonzero(which > 0)
            size = len(fold)
            if not size:
                continue
            gram = np.zeros((size, d, d))
            gram[:, upper[0], upper[1]] = total[fold, :len(cells)]
            gram[:, upper[1], upper[0]] = gram[:, upper[0], upper[1]]
            gram[:, range(1, d), range(1, d)] += ridge
            coef = np.linalg.solve(gram, total[fold, len(cells):, None])[:, :, 0]
            late = np.flatnonzero(part > 0)                       # the folds' days, in order
            owner = np.cumsum(np.isin(late, groups)) - 1
            count = np.bincount(owner, minlength=size)
            h = ((rn - cut)[at[late]] % steps + 1).astype(np.int32)
            x = x[late] if there is None else np.where(there[late], x[late], np.nan)
            z = np.zeros((size, h.max(initial=0) + 1))          # forecasts by item and step
            for step in range(1, z.shape[1]):
                now = h == step
                rows, who = x[now], owner[now]
                for i, k in enumerate(lags):
                    if k < step:
                        rows[:, i + 1] = z[who, step - k]
                z[who, step] = (rows * coef[who]).sum(axis=1)
            whose = item[fold][owner]
            yhat = np.maximum(z[owner, h] * sd[whose] + mu[whose], 0.0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            late = at[late]
            days = pa.StructArray.from_arrays([pa.array(h), pa.array(date[late]).cast(pa.date32()), pa.array(qty[late], mask=~seen[late]), pa.array(yhat)], fields=list(day))
            yield pa.RecordBatch.from_arrays(
                [col["item_id"].take(pa.array(top[item[fold]])), pa.array(which[fold] - 1, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * d, pa.int32()), pa.array(coef.reshape(-1))),
                 pa.ListArray.from_arrays(offsets, days)], names=["item_id", "fold", "coef", "days"])

    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, fold int, coef array<double>, days array<struct<h:int,ds:date,qty:double,yhat:double>>")


def autoregressions(dense: DataFrame, first_cut: Column, steps: int, lags=LAGS, ridge: float = RIDGE) -> DataFrame:
    """One autoregression per item and cut-off, each fitted on all days before it."""
    return solved(series(dense, first_cut, lags), steps, lags, ridge)


def single_series(dense: DataFrame, horizon: int, lags=LAGS) -> DataFrame:
    """item_id, coef and the errors of the last ``horizon`` days of every item whose history
    before them is long enough: a model of its own per item."""
    fits = autoregressions(dense, F.col("n") - horizon, horizon, lags)
    err = F.transform("days", lambda r: F.abs(r["qty"] - r["yhat"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    points = F.size("days")
    return fits.select("item_id", points.cast("long").alias("n_points"), (total(err) / points).alias("mae"),
                       F.sqrt(total(F.transform(err, lambda v: v * v)) / points).alias("rmse"), "coef")


def backtest_refit(dense: DataFrame, steps: int = 7, initial_share: float = 0.8, lags=LAGS) -> DataFrame:
    """Expanding-window back-test with a refit at every cut-off (each ``steps`` days after
    the first ``initial_share`` of an item's days, to its end): folds, and mean / std / min /
    max of their MAE and MAPE, per item."""
    fits = autoregressions(dense, F.floor(F.col("n") * initial_share), steps, lags)
    off = F.transform("days", lambda r: F.abs(r["qty"] - r["yhat"]))
    coarse = F.transform("days", lambda r: F.abs(r["qty"] - F.floor(r["yhat"] * GRAIN + 0.5) / GRAIN) / (r["qty"] + 1e-8))

    def mean(a):
        found = F.filter(a, lambda v: v.isNotNull())
        return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, v: s + v) / F.size(found))

    per_fold = fits.select("item_id", "fold", mean(off).alias("mae"), (mean(coarse) * 100).alias("mape"))
    stats = [f(m).alias(f"{m}_{name}") for m in ("mae", "mape")
             for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return per_fold.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_folds"), *stats)
