"""Scale properties of the physical plans (AQE initial plans at sf0.001)."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL

# per-item operators on the demand series: (item_id, ds) exchange for the daily
# sums, item_id exchange for everything after -- nothing more
TWO_EXCHANGES = ["densify_own_span", "densify_fixed_window", "all_features", "rolling_stats", "fc_tsb",
                 "fc_exp_smoothing", "metrics_mae_rmse", "metrics_inventory", "backtest", "safety_stock",
                 "zero_cv_class", "concentration", "time_until_demand"]


def _plan(spark, name):
    df = E.queries()[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", TWO_EXCHANGES)
def test_series_operators_have_two_exchanges(spark, name):
    plan = _plan(spark, name)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 2, plan
    assert "SinglePartition" not in plan


def test_daily_sums_are_pre_aggregated_before_the_shuffle(spark):
    plan = _plan(spark, "jo_series")
    # partial (map-side) sum below the first exchange: hot parts are combined per task
    assert re.search(r"Exchange hashpartitioning\(item_id#\d+L?, ds#\d+, \d+\)", plan)
    assert "partial_sum(qty" in plan


def test_flagship_exchanges(spark):
    plan = E.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    assert not re.search(r"BatchEvalPython|ArrowEvalPython", plan)


def test_no_python_udfs_anywhere(spark):
    skip = ("ml_", "compare_loss", "model_io", "report_tables", "csv_roundtrip", "wide_import", "sample_export")
    for name in E.queries():
        if name.startswith(skip) or re.match(r"op\d+_|pipeline$", name):
            continue
        plan = _plan(spark, name)
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas", plan), name


def test_date_predicates_reach_the_scan(spark):
    plan = _plan(spark, "jo_consumption")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double", plan)


def test_no_task_sees_all_suppliers_or_parts(spark):
    for name in ("supplier_performance", "training_summary"):
        plan = _plan(spark, name)
        assert "median(" not in plan, name
        assert not re.search(r"Window[^\n]*performance_score", plan), name


def test_aggregate_demand_reads_no_table_twice_for_its_span(spark):
    # the sums are written once; what is left works on them
    assert _plan(spark, "aggregate_demand").count("FileScan parquet") <= 6
