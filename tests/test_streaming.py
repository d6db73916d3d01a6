import os
import shutil
import tempfile

from pyspark.sql import functions as F

from partcast.operators import reshape as R
from partcast.params import EVENTS_PARAMS
from partcast.sources.tables import Tables
from partcast.streaming import daily_demand as S
from tests.conftest import SMALL


def test_events_stream_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="partcast-stream-src-")
    shutil.copy(os.path.join(SMALL, "events.parquet"), os.path.join(src, "part-0.parquet"))
    stream = S.daily_sums(S.events_stream(spark, src), "user_id", "ts", "value", late="0 seconds")
    out = S.run_available(stream, "events_daily")
    got = spark.read.parquet(out)
    batch = R.demand_events(Tables(spark, SMALL), EVENTS_PARAMS.with_(days_back=400))
    # append mode emits the days the watermark has closed: every day but the last
    last = batch.agg(F.max("ds")).first()[0]
    expected = batch.where(F.col("ds") < last)
    got_closed = got.where(F.col("ds") < last)
    assert got_closed.count() == expected.count() > 0
    diff = got_closed.join(expected.withColumnRenamed("qty", "q2"), ["item_id", "ds"]).where(
        F.abs(F.col("qty") - F.col("q2")) > 1e-9)
    assert diff.count() == 0


def test_consumption_stream_matches_batch(spark):
    """Streaming lines joined to static headers give the batch daily sums."""
    from partcast.operators.extract import daily_consumption
    from partcast.params import Params

    t = Tables(spark, SMALL)
    src = tempfile.mkdtemp(prefix="partcast-stream-lines-")
    shutil.copy(os.path.join(SMALL, "lineitem.parquet"), os.path.join(src, "part-0.parquet"))
    raw = spark.readStream.schema(spark.read.parquet(os.path.join(SMALL, "lineitem.parquet")).schema).parquet(src)
    lines = raw.select(
        F.col("l_orderkey").alias("txn_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("qty"),
        F.when(F.col("l_linestatus") == "O", "I").otherwise("O").alias("in_out"),
        F.when(F.col("l_returnflag") == "R", "1").otherwise("0").alias("void"))
    # historical backfill: lateness wider than the data span keeps every day open
    agg = S.consumption_stream(lines, t.jo_txn, late="5000 days")
    q = agg.writeStream.format("memory").queryName("cons_daily").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM cons_daily")
    batch = daily_consumption(t, Params(), None, None)
    assert got.count() == batch.count() > 0
    diff = got.join(batch.withColumnRenamed("qty", "q2"), ["item_id", "ds"]).where(
        F.abs(F.col("qty") - F.col("q2")) > 1e-9)
    assert diff.count() == 0
