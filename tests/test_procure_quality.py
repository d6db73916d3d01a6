import datetime as dt

from pyspark.sql import types as T

from partcast.operators import procure as Q
from partcast.operators import quality as D

FC = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("h", T.IntegerType()),
                   T.StructField("ds", T.DateType()), T.StructField("predicted_demand", T.DoubleType())])
AS_OF = dt.date(2024, 1, 10)


def fc(spark, mapping):
    rows = []
    for item, vals in mapping.items():
        rows += [(item, h + 1, AS_OF + dt.timedelta(days=h + 1), float(v)) for h, v in enumerate(vals)]
    return spark.createDataFrame(rows, FC)


def test_safety_stock_half_even(spark):
    out = {r["h"]: r for r in Q.safety_stock(fc(spark, {1: [0.5, 1.5, 2.5, 2.4]})).collect()}
    assert [out[h]["predicted_demand"] for h in (1, 2, 3, 4)] == [0.0, 2.0, 2.0, 2.0]
    assert out[3]["safety_stock"] == 3.0          # 2.5 * 1.2 = 3.0 taken before rounding


def test_urgent_and_warning_windows(spark):
    f = Q.safety_stock(fc(spark, {1: [0, 3, 0, 0, 0, 0, 0], 2: [0, 0, 4, 0, 0, 0, 9], 3: [0] * 7}))
    urgent = {r["item_id"]: r for r in Q.urgent_orders(f, AS_OF, 2).collect()}
    warning = {r["item_id"]: r for r in Q.warning_orders(f, AS_OF, 2, 7).collect()}
    assert set(urgent) == {1} and urgent[1]["order_by_date"] == AS_OF and urgent[1]["priority"] == "URGENT"
    assert set(warning) == {2} and warning[2]["total_demand"] == 13.0
    assert warning[2]["order_by_date"] == AS_OF + dt.timedelta(days=5)


def test_order_recommendation_and_band(spark):
    f = fc(spark, {1: [1.0] * 14, 2: [0.0] * 14})
    rec = {r["item_id"]: r for r in Q.order_recommendation(f, AS_OF).collect()}
    assert rec[1]["recommended_order_quantity"] == 14 * 1.2
    assert rec[1]["recommended_order_date"] == AS_OF + dt.timedelta(days=7)
    assert rec[2]["recommended_order_quantity"] is None and rec[2]["recommended_order_date"] is None
    band = Q.confidence_band(fc(spark, {1: [-1.0, 10.0]})).orderBy("h").collect()
    assert band[0]["lower_bound"] == 0.0 and band[1]["upper_bound"] == 12.0


def test_missing_dates(spark):
    s = T.StructType([T.StructField("ds", T.DateType())])
    days = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 4),), (dt.date(2024, 1, 4),)], s)
    got = sorted(r["missing_date"] for r in D.dq_missing_dates(days).collect())
    assert got == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]
