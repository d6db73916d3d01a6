"""Splitting of large groups of candidates: all pairs of a group stay within reach of some
task, and no task holds more than two blocks of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block.
LIMIT = 1500


def split_groups(members: DataFrame, key: str, member: str, sizes: DataFrame, limit: int = LIMIT,
                 how: str = "inner") -> DataFrame:
    """Add ``task`` (struct of key, i, j) and ``block``: a group of up to ``limit`` is one
    task (0, 0); one of more has its members hashed into blocks, and each pair of blocks
    i <= j is a task.  ``sizes`` has (key, n) and says which keys take part; with ``how``
    "left" it need only have those above ``limit``."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / limit)).cast("int")
    out = (members.join(sizes.select(F.col(key).alias("_key"), "n"), F.col(key) == F.col("_key"), how)
           .withColumn("_blocks", blocks)
           .withColumn("block", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
           .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))))
    return (out.withColumn("task", F.struct(F.col(key).alias("key"), F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j")))
            .drop("_key", "n", "_blocks", "_other"))


def sides(block, i: int, j: int):
    """Row numbers of the two sides of a task, from its members' blocks (numpy array)."""
    import numpy as np

    if i == j:
        own = np.arange(len(block))
        return own, own
    return np.flatnonzero(block == i), np.flatnonzero(block == j)
