"""Per-item lag, rolling and intermittent-demand features.

Input: a dense series (item_id, ds, qty).  Every feature is a window function
over ``partitionBy(item_id).orderBy(ds)``; frames are row frames with partial
frames allowed at the start (pandas ``min_periods=1``).  All windows share one
exchange and one sort.  Row-loop recurrences of the reference (time since /
until demand, run lengths) become ``last`` / ``first`` with ``ignoreNulls``
over row indices.

Spark evaluates a bounded sliding frame by re-aggregating the whole frame for
every row (O(rows x w)), so none is used.  Sums, means, counts and shares come from
running totals, ``cum(t) - cum(t - w)``; extremes and deviations by doubling (what 2k rows
give comes from two runs of k rows; w rows are two overlapping runs for an extreme, and runs
side by side for a deviation, so no value outside the frame touches it); and the Gini
coefficient from the running total of what each row adds to the frame's sum of absolute
differences, and takes off it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partcast.functions import calendar as C
from partcast.functions.windows import after, by_item, upto

LAGS = (1, 7, 14, 30)
ROLL = (7, 14, 30)
CONCENTRATION = (7, 30)
RUNNING = ("_cs_q", "_cs_zero", "_cs_pos")


def with_running(df: DataFrame, q: str = "qty") -> DataFrame:
    """Adds the row index and running totals used by the rolling sums."""
    w = upto()
    return df.withColumns({
        "_rn": F.row_number().over(by_item()) - 1,
        "_cs_q": F.sum(F.col(q)).over(w),
        "_cs_zero": F.sum(F.when(F.col(q) == 0, 1).otherwise(0)).over(w),
        "_cs_pos": F.sum(F.when(F.col(q) > 0, 1).otherwise(0)).over(w),
    })


def roll_sum(cum: str, k: int) -> Column:
    """Sum over the last k rows from a running total column."""
    return F.col(cum) - F.coalesce(F.lag(cum, k).over(by_item()), F.lit(0))


def rows_in(k: int) -> Column:
    """Rows in a partial frame of length k ending at the current row."""
    return F.least(F.col("_rn") + 1, F.lit(k))


def _rn() -> Column:
    return (F.row_number().over(by_item()) - 1)


def with_rn(df: DataFrame) -> DataFrame:
    return df.withColumn("_rn", _rn())


def lag_cols(q: str = "qty") -> dict[str, Column]:
    out = {}
    for k in LAGS:
        lg = F.lag(q, k).over(by_item())
        out[f"lag_{k}"] = lg
        out[f"had_demand_lag_{k}"] = F.when(lg > 0, 1).otherwise(0)
    return out


def with_runs(df: DataFrame, windows, q: str = "qty") -> DataFrame:
    """Adds ``_min_k``, ``_max_k`` and ``_std_k`` (sample deviation, null for one row) of the last
    k rows (needs :func:`with_running`).  Runs of 1, 2, 4, ... rows have their extremes, sum
    and squared deviations from two of the runs before; a window takes two overlapping runs
    for its extremes and, for its deviation, runs side by side.  A row before an item's first
    counts for nothing."""
    w = by_item()

    def back(column: str, rows: int) -> Column:
        return F.lag(column, rows).over(w) if rows else F.col(column)

    def rows_of(length: int, ago: int) -> Column:
        return F.least(F.col("_rn") + 1 - ago, F.lit(length)).cast("double")

    def extremes(length: int, ago: int) -> tuple[Column, Column]:
        return F.least(f"_lo_{length}", back(f"_lo_{length}", ago)), F.greatest(f"_hi_{length}", back(f"_hi_{length}", ago))

    def merged(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
        """(rows, sum, squared deviations) of two runs; the second may lie before the first row."""
        between = F.col(a[1]) / a[0] - F.col(b[1]) / b[0]
        return (a[0] + F.greatest(b[0], F.lit(0.0)), F.col(a[1]) + F.coalesce(b[1], F.lit(0.0)),
                F.col(a[2]) + F.coalesce(F.col(b[2]) + between * between * a[0] * b[0] / (a[0] + b[0]), F.lit(0.0)))

    scratch = ["_lo_1", "_hi_1", "_s_1", "_d_1"]
    df = df.withColumns({"_lo_1": F.col(q), "_hi_1": F.col(q), "_s_1": F.col(q), "_d_1": F.lit(0.0)})
    length = 1
    while 2 * length <= max(windows):
        lo, hi = extremes(length, length)
        df = df.withColumns({f"_lo_{2 * length}": lo, f"_hi_{2 * length}": hi, "_sb": back(f"_s_{length}", length), "_db": back(f"_d_{length}", length)})
        _, total, dev = merged((rows_of(length, 0), f"_s_{length}", f"_d_{length}"), (rows_of(length, length), "_sb", "_db"))
        length *= 2
        df = df.withColumns({f"_s_{length}": total, f"_d_{length}": dev})
        scratch += [f"_{x}_{length}" for x in ("lo", "hi", "s", "d")]
    for k in windows:
        largest = 1 << (k.bit_length() - 1)
        lo, hi = extremes(largest, k - largest)
        pieces, ago = [], 0
        for bit in range(k.bit_length() - 1, -1, -1):
            if k >> bit & 1:
                pieces.append((1 << bit, ago))
                ago += 1 << bit
        df = df.withColumns({f"_min_{k}": lo, f"_max_{k}": hi} | {f"_{x}b{i}": back(f"_{x}_{n}", ago) for i, (n, ago) in enumerate(pieces) for x in "sd"})
        n = rows_of(*pieces[0])
        df = df.withColumns({"_sa": F.col("_sb0"), "_da": F.col("_db0")})
        for i, piece in enumerate(pieces[1:], 1):
            n, total, dev = merged((n, "_sa", "_da"), (rows_of(*piece), f"_sb{i}", f"_db{i}"))
            df = df.withColumns({"_sa": total, "_da": dev})
        df = df.withColumn(f"_std_{k}", F.when(n > 1, F.sqrt(F.col("_da") / (n - 1))))
        df = df.drop("_sa", "_da", *[f"_{x}b{i}" for i in range(len(pieces)) for x in "sd"])
    return df.drop("_sb", "_db", *scratch)


def rolling_cols(windows=ROLL, counts: bool = True, stats: bool = True) -> dict[str, Column]:
    """Rolling statistics (need :func:`with_running`, and :func:`with_runs` for ``stats``)."""
    out = {}
    for k in windows:
        if stats:
            out[f"rolling_mean_{k}"] = roll_sum("_cs_q", k) / rows_in(k)
            out[f"rolling_std_{k}"] = F.col(f"_std_{k}")
            out[f"rolling_max_{k}"] = F.col(f"_max_{k}")
            out[f"rolling_min_{k}"] = F.col(f"_min_{k}")
        if counts:
            zc = roll_sum("_cs_zero", k)
            out[f"rolling_zero_count_{k}"] = zc
            out[f"rolling_nonzero_count_{k}"] = roll_sum("_cs_pos", k)
            out[f"intermittency_ratio_{k}"] = zc / F.lit(float(k))
    return out


def since_col(q: str = "qty") -> Column:
    """Rows since the last qty > 0 (0 on demand days and before the first demand)."""
    last_pos = F.last(F.when(F.col(q) > 0, F.col("_rn")), ignorenulls=True).over(upto())
    return F.coalesce(F.col("_rn") - last_pos, F.lit(0))


def until_col(q: str = "qty", default: int = 30) -> Column:
    """Rows until the next qty > 0 strictly after this row; ``default`` if none.
    Reads the future -- never a training feature."""
    nxt = F.first(F.when(F.col(q) > 0, F.col("_rn")), ignorenulls=True).over(after())
    return F.coalesce(nxt - F.col("_rn"), F.lit(default))


def run_cols(q: str = "qty") -> dict[str, Column]:
    brk_zero = F.last(F.when(F.col(q) != 0, F.col("_rn")), ignorenulls=True).over(upto())
    brk_dem = F.last(F.when(F.col(q) <= 0, F.col("_rn")), ignorenulls=True).over(upto())
    return {
        "zero_run_length": F.col("_rn") - F.coalesce(brk_zero, F.lit(-1)),
        "demand_run_length": F.col("_rn") - F.coalesce(brk_dem, F.lit(-1)),
    }


def with_differences(df: DataFrame, windows=CONCENTRATION, q: str = "qty") -> DataFrame:
    """Adds ``_diff_k``, the sum of absolute differences of all pairs within the last k rows: a
    row brings its differences to the k - 1 before it, and ends those of the row that leaves."""
    w, back = by_item(), {0: F.col(q)} | {j: F.col(f"_back_{j}") for j in range(1, max(windows) + 1)}
    df = df.withColumns({f"_back_{j}": F.lag(q, j).over(w) for j in back if j})
    change = {}
    for k in windows:
        brought = sum((F.coalesce(F.abs(back[0] - back[j]), F.lit(0.0)) for j in range(1, k)), F.lit(0.0))
        ended = sum((F.abs(back[k] - back[j]) for j in range(1, k)), F.lit(0.0))
        change[f"_change_{k}"] = brought - F.coalesce(ended, F.lit(0.0))
    df = df.withColumns(change).drop(*[f"_back_{j}" for j in back if j])
    return df.withColumns({f"_diff_{k}": F.sum(f"_change_{k}").over(upto()) for k in windows}).drop(*change)


def gini_col(k: int) -> Column:
    """Rolling Gini coefficient over the last k rows (needs :func:`with_running` and
    :func:`with_differences`); 0 when the frame sums to 0."""
    n, s = rows_in(k), roll_sum("_cs_q", k)
    ranked = F.col(f"_diff_{k}") + (n + 1) * s          # twice the sum of rank times value
    return F.when((s == 0) | (roll_sum("_cs_zero", k) == n), F.lit(0.0)).otherwise(ranked / (n * s) - (n + 1) / n)


def probability_cols(q: str = "qty") -> dict[str, Column]:
    """Rolling share of demand days (needs :func:`with_running`)."""
    return {"demand_probability_7d": roll_sum("_cs_pos", 7) / rows_in(7),
            "demand_probability_30d": roll_sum("_cs_pos", 30) / rows_in(30)}


def interval_col() -> Column:
    """30-row mean of ``time_since_last_demand`` (needs its running total ``_cs_since``)."""
    return roll_sum("_cs_since", 30) / rows_in(30)


def intermittent_cols(q: str = "qty", include_lookahead: bool = True) -> dict[str, Column]:
    out = {"time_since_last_demand": since_col(q)}
    if include_lookahead:
        out["time_until_next_demand"] = until_col(q)
    out.update(run_cols(q))
    return out | concentration_cols()


def concentration_cols() -> dict[str, Column]:
    return {f"demand_concentration_{k}d": gini_col(k) for k in CONCENTRATION}


def _add(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.withColumns(cols)


def _clean(df: DataFrame) -> DataFrame:
    return df.drop("_rn", "_cs_since", *RUNNING, *[f"_{x}_{k}" for x in ("min", "max", "std", "diff") for k in (*ROLL, *CONCENTRATION)])


# -- public operators (DataFrame -> DataFrame) --------------------------------------
def lags(dense: DataFrame) -> DataFrame:
    return _add(dense, lag_cols())


def rolling_stats(dense: DataFrame) -> DataFrame:
    return _clean(_add(with_runs(with_running(dense), ROLL), rolling_cols(counts=False)))


def rolling_counts(dense: DataFrame) -> DataFrame:
    return _clean(_add(with_running(dense), rolling_cols(stats=False)))


def time_since_demand(dense: DataFrame) -> DataFrame:
    return with_rn(dense).withColumn("time_since_last_demand", since_col()).drop("_rn")


def time_until_demand(dense: DataFrame) -> DataFrame:
    return with_rn(dense).withColumn("time_until_next_demand", until_col()).drop("_rn")


def run_lengths(dense: DataFrame) -> DataFrame:
    return _add(with_rn(dense), run_cols()).drop("_rn")


def concentration(dense: DataFrame) -> DataFrame:
    return _clean(_add(with_differences(with_running(dense)), concentration_cols()))


def demand_prob(dense: DataFrame) -> DataFrame:
    out = _add(with_running(dense), {"time_since_last_demand": since_col(), **probability_cols()})
    out = out.withColumn("_cs_since", F.sum("time_since_last_demand").over(upto()))
    return _clean(out.withColumn("avg_demand_interval_30d", interval_col()))


def all_features(dense: DataFrame, include_lookahead: bool = True) -> DataFrame:
    """Lags (8) + rolling (21) + intermittent (9) + business-day (17) = 55 columns.
    ``include_lookahead=False`` drops ``time_until_next_demand`` (it leaks the target)."""
    df = with_differences(with_runs(with_running(dense), ROLL))
    cols: dict[str, Column] = {}
    cols.update(lag_cols())
    cols.update(rolling_cols())
    cols.update(intermittent_cols(include_lookahead=include_lookahead))
    df = df.withColumns(cols)
    df = df.withColumn("_cs_since", F.sum("time_since_last_demand").over(upto()))
    df = df.withColumns({"avg_demand_interval_30d": interval_col(), **probability_cols()})
    df = df.withColumns(C.business_features(F.col("ds")))
    return _clean(df)


def light_features(dense: DataFrame) -> DataFrame:
    """dow/dom/week/month + cyclic dow and month + rolling mean 7, std 7 (NULL -> 0), mean 30."""
    ds = F.col("ds")
    d, m = C.dow(ds), F.month(ds)
    return _clean(with_runs(with_running(dense), (7,)).withColumns({
        "dayofweek": d, "day": F.dayofmonth(ds), "week": F.weekofyear(ds), "month": m,
        "dayofweek_sin": C.cyc(d, 7, F.sin), "dayofweek_cos": C.cyc(d, 7, F.cos),
        "month_sin": C.cyc(m, 12, F.sin), "month_cos": C.cyc(m, 12, F.cos),
        "rolling_mean_7": roll_sum("_cs_q", 7) / rows_in(7),
        "rolling_std_7": F.coalesce("_std_7", F.lit(0.0)),
        "rolling_mean_30": roll_sum("_cs_q", 30) / rows_in(30),
    }))


# -- calendar operators over the rows of a series ------------------------------------
def calendar_basic(df: DataFrame) -> DataFrame:
    return df.withColumns(C.basic(F.col("ds")))


def calendar_cyclic(df: DataFrame) -> DataFrame:
    return df.withColumns(C.cyclic(F.col("ds")))


def calendar_holiday(df: DataFrame, holidays, country: str | None = None) -> DataFrame:
    """Holiday flag and distances of every row, after the holidays of its ``country`` (a column
    of both; all rows share the holidays where it is None).  ``holidays`` is a table with
    ``ds``, or a list of dates."""
    marks = holiday_table(df.sparkSession, holidays)
    key = F.col(country).cast("string") if country else F.lit("")
    days = df.select(key.alias("_country"), F.col("ds").alias("_ds")).distinct()
    near = nearest(days, marks.select((F.col(country).cast("string") if country else F.lit("")).alias("_country"), F.col("ds").alias("_ds")), ["_country"], "_ds")
    out = df.join(near, key.eqNullSafe(F.col("_country")) & F.col("ds").eqNullSafe(F.col("_ds")), "left")
    return out.withColumns(C.holiday(F.col("ds"), F.col("_before"), F.col("_after"))).drop("_country", "_ds", "_before", "_after")


def holiday_table(spark, holidays) -> DataFrame:
    if isinstance(holidays, DataFrame):
        return holidays
    return spark.createDataFrame([(h,) for h in holidays], "ds date")


def nearest(days: DataFrame, marks: DataFrame, by: list[str], on: str) -> DataFrame:
    """As-of join of the days with the marks of their group: ``_before``, the latest mark on or
    before, and ``_after``, the first after.  Both sides are united, a day and a mark that
    coincide being one row, and the marks carried along; a group has one row per day."""
    both = (days.select(*by, on, F.lit(None).cast("date").alias("_mark"), F.lit(True).alias("_asked"))
            .unionByName(marks.select(*by, on, F.col(on).alias("_mark"), F.lit(False).alias("_asked")))
            .groupBy(*by, on).agg(F.max("_mark").alias("_mark"), F.max("_asked").alias("_asked")))
    w = Window.partitionBy(*by).orderBy(on)
    carried = both.withColumns({
        "_before": F.last("_mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.first("_mark", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    return carried.where("_asked").select(*by, on, "_before", "_after")


def bday_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(C.bday_flags(F.col("ds")))


def bday_of_month(df: DataFrame) -> DataFrame:
    return df.withColumn("business_day_of_month", C.business_day_of_month(F.col("ds")))


def weekend_distance(df: DataFrame) -> DataFrame:
    return df.withColumns(C.weekend_distance(F.col("ds")))


def calendar_exog(dense: DataFrame, horizon: int, holidays) -> DataFrame:
    """Date dimension from the first series day to the last day + horizon, with
    all calendar features.  Bounded by the calendar span, not by the data volume."""
    span = dense.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", F.date_add("hi", horizon))).alias("ds"))
    ds = F.col("ds")
    return calendar_holiday(days.withColumns({**C.basic(ds), **C.cyclic(ds)}), holidays)
