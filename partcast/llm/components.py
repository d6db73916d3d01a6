"""Connected components by alternating large-star and small-star.

Each step is a grouped minimum (combined before the shuffle) and a join back to the edges,
whose hot side Spark can split; the edges of an iteration are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.llm.base import materialise


def _least(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("k")).agg(F.min(value).alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, "u", "v").withColumn("m", F.least("k", "m"))
    return (both.where("v > u").join(least, F.col("u") == F.col("k"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, "u", "v")
    moved = down.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component: the least node reachable, for every node with an edge.

    ``edges`` has two columns of one type, read as undirected; loops are ignored.
    """
    a, b = edges.columns
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    now, last = materialise(now, label), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        now = materialise(small_star(large_star(now)), label)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
