import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from partcast.functions import calendar as C
from partcast.operators import features as Fe
from partcast.operators import reshape as R
from tests.helpers import SCHEMA, column


def test_densify_own_span_gaps_and_null_keys(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, d, 3.0), (1, d + dt.timedelta(days=4), 2.0), (2, d, 1.0), (None, d, 9.0)]
    out = R.densify_own_span(spark.createDataFrame(rows, SCHEMA))
    assert column(out.where("item_id = 1"), "qty") == [3.0, 0.0, 0.0, 0.0, 2.0]
    assert out.where("item_id = 2").count() == 1
    assert out.where("item_id IS NULL").count() == 0


def test_densify_fixed_window(spark):
    d = dt.date(2024, 1, 10)
    rows = [(1, d, 5.0), (1, dt.date(2023, 12, 1), 7.0)]     # second row is outside the window
    out = R.densify_fixed_window(spark.createDataFrame(rows, SCHEMA), dt.date(2024, 1, 1), dt.date(2024, 1, 12))
    vals = column(out, "qty")
    assert len(vals) == 12 and vals[9] == 5.0 and sum(vals) == 5.0


def test_split_80_20_status(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, d + dt.timedelta(days=i), 1.0) for i in range(40)] + [(2, d + dt.timedelta(days=i), 1.0)
                                                                       for i in range(5)]
    out = R.split_80_20(spark.createDataFrame(rows, SCHEMA), 30)
    counts = {(r["item_id"], r["split"]): r["count"] for r in out.groupBy("item_id", "split").count().collect()}
    assert counts == {(1, "train"): 32, (1, "validation"): 8, (2, "insufficient_data"): 5}


def test_business_day_of_month_closed_form(spark):
    start, days = dt.date(2023, 1, 1), 800
    df = spark.range(days).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("ds"))
    got = {r["ds"]: r["b"] for r in df.select("ds", C.business_day_of_month(F.col("ds")).alias("b")).collect()}
    for ds, b in got.items():
        first = ds.replace(day=1)
        brute = sum(1 for i in range(ds.day) if (first + dt.timedelta(days=i)).weekday() < 5)
        assert b == brute, ds


def test_holiday_distances(spark):
    hol = (dt.date(2024, 1, 1), dt.date(2024, 3, 1))
    s = T.StructType([T.StructField("ds", T.DateType())])
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 20),), (dt.date(2024, 2, 25),),
                                (dt.date(2024, 6, 1),)], s)
    out = {r["ds"]: r for r in Fe.calendar_holiday(df, hol).collect()}
    assert out[dt.date(2024, 1, 1)]["is_holiday"] == 1 and out[dt.date(2024, 1, 1)]["days_from_holiday"] == 0
    assert out[dt.date(2024, 1, 20)]["days_from_holiday"] == 19
    assert out[dt.date(2024, 1, 20)]["days_to_holiday"] == 30          # 41 days, capped
    assert out[dt.date(2024, 2, 25)]["days_to_holiday"] == 5
    assert out[dt.date(2024, 6, 1)]["days_to_holiday"] == 30           # none ahead: 999 capped


def test_holidays_by_country_against_the_plain_way(spark):
    """Each row after its own country's holidays; any number of either, none included."""
    import datetime as dt
    import random

    rng, first = random.Random(4), dt.date(2023, 1, 1)
    marks = [(c, first + dt.timedelta(days=rng.randrange(700))) for c in ("AA", "BB", "CC") for _ in range({"AA": 3, "BB": 60, "CC": 0}[c])]
    rows = [(k, c, first + dt.timedelta(days=rng.randrange(800))) for k, c in enumerate(("AA", "BB", "CC", None) * 120)] + [(900, "AA", None)]
    holidays = spark.createDataFrame(marks, "country string, ds date")
    got = Fe.calendar_holiday(spark.createDataFrame(rows, "id long, country string, ds date"), holidays, "country").collect()
    assert len(got) == len(rows)
    for r in got:
        own = [d for c, d in marks if c == r["country"] and r["ds"]]
        back = min(((r["ds"] - d).days for d in own if d <= r["ds"]), default=999)
        ahead = min(((d - r["ds"]).days for d in own if d > r["ds"]), default=999)
        assert (r["is_holiday"], r["days_to_holiday"], r["days_from_holiday"]) == (int(back == 0), min(ahead, 30), min(back, 30))


def test_many_holidays_are_no_literals(spark):
    import datetime as dt

    holidays = [dt.date(1900, 1, 1) + dt.timedelta(days=9 * k) for k in range(6000)]
    df = spark.createDataFrame([(1, dt.date(2000, 1, 5))], "id long, ds date")
    out = Fe.calendar_holiday(df, holidays)
    assert "1900-01-10" not in out._jdf.queryExecution().optimizedPlan().toString()[:100_000].split("LocalRelation")[0]
    row = out.first()
    assert row["days_to_holiday"] + row["days_from_holiday"] == 9
