"""Reads by schema, key bounds and pushed filters."""

import pytest
from pyspark.sql import functions as F

from partcast.plans.registry import queries
from partcast.sources.bounded import BoundedReader, BoundedTable, BoundedTables, KeyRange, ranges
from partcast.sources.tables import Tables
from tests.conftest import SMALL


def test_ranges_cover_every_key_once():
    assert ranges(1, 10, 3) == [KeyRange(None, 4), KeyRange(4, 7), KeyRange(7, None)]
    assert ranges(5, 5, 8) == [KeyRange(None, None)] and len(ranges(0, 2, 8)) == 3


def test_tables_are_the_same_rows(spark):
    plain, bounded = Tables(spark, SMALL), BoundedTables(spark, SMALL, parts=5)
    for name in ("jo_txn", "jo_item", "sorder_txn", "sorder_item", "porder_txn", "porder_item", "product_code"):
        a, b = getattr(plain, name), getattr(bounded, name)
        assert a.schema == b.schema and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert bounded.raw("lineitem").rdd.getNumPartitions() == 5


def test_bounds_filters_and_nulls(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(k if k % 7 else None, f"v{k % 5}", float(k)) for k in range(200)]
    spark.createDataFrame(rows, "k long, v string, x double").repartition(3).write.parquet(path)
    spark.dataSource.register(BoundedTable)
    df = (spark.read.format("bounded").schema("v string, x double, k long").option("path", path).option("key", "k")
          .option("lower", 50).option("upper", 120).option("partitions", 4).load())
    assert df.columns == ["v", "x", "k"] and df.count() == 200                       # bounds plan, they do not filter
    got = df.where((F.col("x") >= 20) & (F.col("x") < 90) & F.col("v").isin("v1", "v3") & F.col("k").isNotNull() & (F.length("v") == 2))
    assert sorted(r["x"] for r in got.collect()) == [float(k) for k in range(20, 90) if k % 5 in (1, 3) and k % 7]
    plan = df.where("x >= 20 AND length(v) = 2")._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]
    assert "length(v" in above and "x#" not in above.split("Filter")[-1].split("length")[0]   # the comparison is left to the scan
    with pytest.raises(Exception, match="given schema"):
        spark.read.format("bounded").option("path", path).load()


def test_a_session_without_pushdown_reads_the_same(spark):
    """Spark's default: it refuses a reader that takes filters."""
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "false")
    try:
        plain, bounded = Tables(spark, SMALL).jo_item, BoundedTables(spark, SMALL, parts=3).jo_item
        assert bounded.count() == plain.count() > 0
        some = [df.where("qty > 20 AND txn_id <= 900 AND stk_id IS NOT NULL") for df in (plain, bounded)]
        assert some[0].exceptAll(some[1]).count() == 0 and some[0].count() == some[1].count() > 0
        assert {r["rows"] for r in queries()["scan_tables"](spark, SMALL).collect()} >= {plain.count()}
    finally:
        spark.conf.set(key, "true")


def test_the_scan_reads_its_range_only(spark, tmp_path):
    spark.range(100).selectExpr("id AS k").write.parquet(f"{tmp_path}/t")
    schema = spark.read.parquet(f"{tmp_path}/t").schema
    reader = BoundedReader(f"{tmp_path}/t", schema, "k", 0, 99, 4)
    parts = [[v for b in reader.read(p) for v in b.column(0).to_pylist()] for p in reader.partitions()]
    assert [sorted(p) for p in parts] == [list(range(25 * i, 25 * i + 25)) for i in range(4)]
    reader.pushed = [("k", ">", 90)]
    assert sorted(v for p in reader.partitions() for b in reader.read(p) for v in b.column(0).to_pylist()) == list(range(91, 100))


def test_the_scan_does_not_run_ahead(spark, tmp_path):
    """While Spark works on a batch, no further row groups are decoded."""
    import time

    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    n, rng = 1_500_000, np.random.default_rng(1)
    path = f"{tmp_path}/wide.parquet"
    pq.write_table(pa.table({"k": np.arange(n), "x": rng.random(n), "y": rng.random(n)}), path, row_group_size=100_000)
    reader = BoundedReader(path, spark.read.parquet(path).schema, "k", 0, n - 1, 1)
    before, rows, most = pa.total_allocated_bytes(), 0, 0
    for k, batch in enumerate(reader.read(KeyRange(None, None))):
        rows += len(batch)
        if k < 3:
            time.sleep(0.3)
            most = max(most, pa.total_allocated_bytes() - before)
    assert rows == n and most < 8e6
