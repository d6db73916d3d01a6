"""Global order statistics without a task that sees all rows.

Distinct values are counted first (ties, however many, become one row), range-partitioned,
summed within their partition, and shifted by the totals of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partcast.session import cut_lineage


def positions(df: DataFrame, value: str, group: Column | None = None, descending: bool = False) -> DataFrame:
    """grp, val, ties, before: every distinct value of a group, the rows that have it, and
    the rows of the group that come before it.  Null values are left out."""
    grp = (group if group is not None else F.lit(0)).alias("grp")
    counts = df.where(F.col(value).isNotNull()).groupBy(grp, F.col(value).alias("val")).agg(F.count(F.lit(1)).alias("ties"))
    order = [F.col("grp"), F.col("val").desc() if descending else F.col("val").asc()]
    parted = cut_lineage(counts.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    # one row per partition, in the order of the ranges
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = (parted.groupBy("_p").agg(F.sum("ties").alias("_t"))
             .select("_p", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_shift")))
    inner = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = parted.withColumn("_in", F.sum("ties").over(inner) - F.col("ties")).join(shift, "_p")
    total = total.select("grp", "val", "ties", (F.col("_shift") + F.col("_in")).alias("_all"))
    starts = total.groupBy("grp").agg(F.min("_all").alias("_first"))
    return total.join(starts, "grp").select("grp", "val", "ties", (F.col("_all") - F.col("_first")).alias("before"))


def medians(df: DataFrame, value: str, group: str) -> DataFrame:
    """<group>, median: the exact median of each group."""
    pos = positions(df, value, F.col(group))
    sizes = pos.groupBy("grp").agg(F.sum("ties").alias("_n"))
    lo, hi = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    at = pos.join(sizes, "grp")
    covers = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("ties"))
    return (at.groupBy("grp").agg(((F.max(F.when(covers(lo), F.col("val"))) + F.max(F.when(covers(hi), F.col("val")))) / 2).alias("median"))
            .withColumnRenamed("grp", group))


def ordinals(df: DataFrame, key: str) -> DataFrame:
    """<key>, code: 0-based place of each distinct key in ascending order."""
    return positions(df.select(key).distinct(), key).select(F.col("val").alias(key), F.col("before").cast("double").alias("code"))
