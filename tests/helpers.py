import datetime as dt

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("ds", T.DateType()),
                       T.StructField("qty", T.DoubleType())])


def series(spark, values, item_id=1, start=dt.date(2024, 1, 1)):
    rows = [(item_id, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def multi(spark, mapping, start=dt.date(2024, 1, 1)):
    rows = []
    for item, values in mapping.items():
        rows += [(item, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name, order="ds"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]
