import datetime as dt

import pytest
from pyspark.sql import types as T

from partcast.operators import classify as K
from partcast.operators import leadtime as L
from tests.helpers import multi


def test_sbc_edges(spark):
    daily = multi(spark, {1: [0, 0, 0, 7, 0], 2: [0] * 30, 3: [5, 5, 5, 5, 5, 5]})
    got = {r["item_id"]: r for r in K.sbc_class(daily.where("qty != 0"), None).collect()}
    # item 2 has no rows at all once zeros are dropped: it does not exist sparse
    assert 2 not in got
    full = {r["item_id"]: r for r in K.sbc_class(daily, 30).collect()}
    assert full[1]["demand_pattern"] == "Lumpy" and full[1]["cv2"] is None   # single demand
    assert full[2]["cv2"] == 0.0 and full[2]["adi"] == 30                       # no demand
    assert full[3]["demand_pattern"] == "Smooth"       # daily demand, constant size
    assert full[3]["adi"] == pytest.approx(1.0)


def test_supplier_ties_and_null_key(spark):
    schema = T.StructType([T.StructField(c, t) for c, t in [
        ("item_id", T.LongType()), ("order_date", T.DateType()), ("eta_date", T.DateType()),
        ("actual_receive_date", T.DateType()), ("supplier_id", T.LongType()), ("quantity", T.DoubleType())]])
    d = dt.date(2024, 1, 1)
    rows = []
    for sup in (1, 2):           # identical histories -> equal scores -> average rank 1.5
        rows += [(10, d, d + dt.timedelta(days=5), d + dt.timedelta(days=5), sup, 1.0),
                 (10, d, d + dt.timedelta(days=9), d + dt.timedelta(days=10), sup, 1.0)]
    rows += [(10, d, d + dt.timedelta(days=5), None, None, 1.0)]   # null supplier: dropped
    rows += [(11, d, d + dt.timedelta(days=4), d + dt.timedelta(days=4), 3, 1.0)]   # single order: unranked
    lt = L.lead_times(spark.createDataFrame(rows, schema))
    perf = {r["supplier_id"]: r for r in L.supplier_performance(lt).collect()}
    assert set(perf) == {1, 2, 3}
    assert perf[1]["supplier_rank"] == perf[2]["supplier_rank"] == 1.5
    assert perf[3]["performance_score"] is None and perf[3]["supplier_rank"] is None
    stats = L.lead_time_stats(lt).collect()
    assert {(r["item_id"], r["supplier_id"]) for r in stats} == {(10, 1), (10, 2)}


def _lt_schema():
    return T.StructType([T.StructField(c, t) for c, t in [
        ("item_id", T.LongType()), ("order_date", T.DateType()), ("eta_date", T.DateType()),
        ("actual_receive_date", T.DateType()), ("supplier_id", T.LongType()), ("quantity", T.DoubleType())]])


def test_lead_time_dynamic_windows_and_trend(spark):
    ref = dt.date(2024, 6, 30)
    rows = []
    # lead time grows by one day every 10 days of order date: slope 0.1
    for i in range(10):
        od = ref - dt.timedelta(days=170 - 10 * i)
        rows.append((1, od, od + dt.timedelta(days=5 + i), od + dt.timedelta(days=5 + i), 7, 1.0))
    lt = L.lead_times(spark.createDataFrame(rows, _lt_schema()))
    r = L.lead_time_dynamic(lt, ref).collect()[0]
    assert r["order_count_180d"] == 10 and r["lead_time_trend_180d"] == pytest.approx(0.1)
    # nothing in the last 30 days: mean / std NULL, trend 0, count 0
    assert r["order_count_30d"] == 0 and r["lead_time_mean_30d"] is None and r["lead_time_trend_30d"] == 0.0
    # the 90-day look-back holds the orders of ref-90 and ref-80 (lower bound inclusive)
    assert r["order_count_90d"] == 2 and r["lead_time_trend_90d"] == pytest.approx(0.1)
    assert r["lead_time_std_60d"] is None               # one order: sample std undefined


def test_procurement_urgency_bins(spark):
    from partcast.operators.leadtime import procurement_urgency
    s = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("lead_time_p95_all_suppliers", T.DoubleType())])
    df = spark.createDataFrame([(1, 0.0), (2, 7.0), (3, 20.0), (4, 30.0), (5, -7.0)], s)
    got = {r["item_id"]: r for r in procurement_urgency(df, 7).collect()}
    assert got[1]["order_urgency"] == "immediate" and got[1]["needs_immediate_order"] == 1
    assert got[2]["order_urgency"] == "urgent" and got[2]["needs_urgent_order"] == 1
    assert got[3]["order_urgency"] == "normal" and got[4]["order_urgency"] == "low"
    assert got[5]["order_urgency"] is None             # required lead days <= 0: outside every bin
