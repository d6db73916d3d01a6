"""Hand-computed recurrences (SURVEY 5, unit series 'mixed')."""

import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partcast.operators import features as Fe
from tests.helpers import column, series

MIXED = [0, 0, 5, 0, 0, 3, 2, 0]


def test_time_since_and_until(spark):
    df = series(spark, MIXED)
    assert column(Fe.time_since_demand(df), "time_since_last_demand") == [0, 0, 0, 1, 2, 0, 0, 1]
    assert column(Fe.time_until_demand(df), "time_until_next_demand") == [2, 1, 3, 2, 1, 1, 30, 30]


def test_run_lengths(spark):
    out = Fe.run_lengths(series(spark, MIXED))
    assert column(out, "zero_run_length") == [1, 2, 0, 1, 2, 0, 0, 1]
    assert column(out, "demand_run_length") == [0, 0, 1, 0, 0, 1, 2, 0]


def test_gini_last_frame(spark):
    g = column(Fe.concentration(series(spark, MIXED)), "demand_concentration_7d")
    assert g[-1] == pytest.approx(0.657143, abs=1e-6)
    assert g[0] == 0.0   # frame sums to zero


def test_rolling_partial_frames(spark):
    out = Fe.rolling_counts(series(spark, MIXED))
    # partial frame at the start still divides by the window length
    assert column(out, "intermittency_ratio_7")[0] == pytest.approx(1 / 7)
    assert column(out, "rolling_nonzero_count_7")[-1] == 3
    std = column(Fe.rolling_stats(series(spark, MIXED)), "rolling_std_7")
    assert std[0] is None      # sample std of one value


def test_all_features_column_count(spark):
    out = Fe.all_features(series(spark, MIXED))
    assert len(out.columns) - 3 == 55
    assert "time_until_next_demand" not in Fe.all_features(series(spark, MIXED), include_lookahead=False).columns


def test_lags_flags(spark):
    out = Fe.lags(series(spark, MIXED))
    assert column(out, "lag_1")[:3] == [None, 0.0, 0.0]
    assert column(out, "had_demand_lag_1") == [0, 0, 0, 1, 0, 0, 1, 1]


def test_rolling_means_after_a_huge_value(spark):
    values = [1e9] + [0.1 * (k % 7) for k in range(60)]
    out = column(Fe.all_features(series(spark, values)), "rolling_mean_7")
    want = [sum(values[max(0, k - 6):k + 1]) / (min(k, 6) + 1) for k in range(len(values))]
    assert all(abs(a - b) < 1e-6 for a, b in zip(out[7:], want[7:]))


def plain_gini(x):
    s, n = sum(x), len(x)
    return 2 * sum((i + 1) * v for i, v in enumerate(sorted(x))) / (n * s) - (n + 1) / n if s else 0.0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 2.5, 7, 7, 1000, 0.1]), min_size=1, max_size=80))
def test_windows_against_their_frames(spark, values):
    """Extremes, deviations and concentration equal those of the frame itself."""
    rows = Fe.all_features(series(spark, values)).orderBy("ds").collect()
    for t, r in enumerate(rows):
        for k in (7, 14, 30):
            f = values[max(0, t - k + 1):t + 1]
            assert (r[f"rolling_min_{k}"], r[f"rolling_max_{k}"]) == (min(f), max(f))
            assert r[f"rolling_std_{k}"] == (pytest.approx(statistics.stdev(f), abs=1e-9) if len(f) > 1 else None)
        for k in (7, 30):
            assert r[f"demand_concentration_{k}d"] == pytest.approx(plain_gini(values[max(0, t - k + 1):t + 1]), abs=1e-9)


def test_deviation_after_a_huge_value(spark):
    values = [1e9] + [0.1 * (k % 7) for k in range(60)]
    out = column(Fe.rolling_stats(series(spark, values)), "rolling_std_7")
    assert all(a == pytest.approx(statistics.stdev(values[k - 6:k + 1]), rel=1e-9) for k, a in enumerate(out) if k > 7)


def test_no_sliding_frames(spark):
    """Frames are unbounded or a single earlier row; no array is sorted."""
    import re

    for op in (Fe.rolling_stats, Fe.concentration, Fe.all_features, Fe.light_features):
        plan = op(series(spark, MIXED))._jdf.queryExecution().executedPlan().toString()
        frames = set(re.findall(r"specifiedwindowframe\(RowFrame, ([^,()]+)[()]*, ([^,()]+)", plan))
        assert "array_sort" not in plan and frames
        assert all(a == b or "unbounded" in a or "unbounded" in b for a, b in frames), frames
