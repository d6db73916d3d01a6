"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partcast.session import ensure_checkpoint_dir

#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, survives the loss of executors, and is computed once."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/partcast-llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_text(text="text"):
    """The text, or the empty text for null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def whole_rows(df: DataFrame) -> DataFrame:
    """The rows as one struct column ``doc``, so that no column added meets one of theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))


def unwrapped(df: DataFrame, columns: list[str], new: dict | None = None) -> DataFrame:
    """The columns of ``doc`` again, some replaced."""
    new = new or {}
    return df.select(*[(new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in columns])


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, chunks: int) -> DataFrame:
    """Exclusive running total of ``value`` over each key in a fixed order, without a
    task that sees a whole key: rows fall into ``chunks`` hashed chunks of a key, each is
    summed by a window, and the chunks' totals (``chunks`` rows a key) give the offsets.
    The order is (chunk, ``order``); rows equal in ``order`` are interchangeable.
    """
    from pyspark.sql import Window as W

    parts = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    within = (W.partitionBy(*keys, "_chunk").orderBy(*order)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    inner = parts.withColumn("_in", F.sum(value).over(within) - F.col(value))
    over = W.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_c").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = (parts.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"))
              .agg(F.sum(value).alias("_t"))
              .withColumn("_before", F.sum("_t").over(over) - F.col("_t")).drop("_t"))
    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (inner.join(totals, same)
            .withColumn(out, (F.col("_before") + F.col("_in")).cast("long"))
            .drop("_chunk", "_in", "_c", "_before", *[f"_k{i}" for i in range(len(keys))]))


def chunks_for(rows: int) -> int:
    """Chunks of a key for ``prefix_sums``: both the chunk and the list of chunk totals
    grow as the root of the rows."""
    return max(1, int(rows ** 0.5))
