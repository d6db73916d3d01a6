"""Token counts: the exact histogram of encoded lengths and what its sums answer.

Documents are aggregated by encoded length before anything is shuffled, so all later
work is on one row per distinct length.  Suffix sums over the lengths (in blocks of
lengths, so that no task needs the whole histogram) give, for any context limit, the
documents at least that long, the total, the total after truncation, and quantiles.

Defined results: a null or empty text has the length of its end token alone (0 without
one); very long texts are encoded whole; documents of equal length are one row of the
histogram, counted each; repeated rows count each time; an empty table gives no rows (and null totals);
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partcast.llm.base import materialise
from partcast.llm.tokens import DEFAULT_TOKENIZER, encoded

#: Lengths in a block of the two-level sums.
BLOCK = 4096


def lengths(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_tokens: int = 0) -> DataFrame:
    """``n_tokens`` of each document."""
    def run(batches):
        import pyarrow as pa

        for part, ids in encoded(batches, tokenizer):
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array([len(x) + end_tokens for x in ids], pa.int64())})

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def histogram(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_tokens: int = 0) -> DataFrame:
    """n_tokens, n_docs: one row per encoded length that occurs."""
    return lengths(docs, tokenizer, end_tokens).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def with_sums(hist: DataFrame) -> DataFrame:
    """The histogram with, per length L: docs_ge / tokens_ge (documents of at least L and
    their tokens), truncated_total (tokens if every document is cut at L), and
    share_le (share of documents of at most L)."""
    rows = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
                       F.floor(F.col("n_tokens") / BLOCK).cast("long").alias("block"))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = (rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
              # one row per BLOCK lengths: a few hundred rows even for texts of millions of tokens
              .select("block", (F.sum("d").over(after) - F.col("d")).alias("d_after"),
                      (F.sum("t").over(after) - F.col("t")).alias("t_after"),
                      F.sum("d").over(W.partitionBy()).alias("all_docs"), F.sum("t").over(W.partitionBy()).alias("all_tokens")))
    within = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = (rows.join(blocks, "block")
              .withColumn("docs_ge", F.sum("n_docs").over(within) + F.col("d_after"))
              .withColumn("tokens_ge", F.sum("tokens").over(within) + F.col("t_after")))
    return (summed
            .select("n_tokens", "n_docs", "tokens", "docs_ge", "tokens_ge",
                    (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
                    ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("share_le")))


def context_table(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_tokens: int = 0) -> DataFrame:
    """The histogram with its sums; the texts are encoded once."""
    return with_sums(materialise(histogram(docs, tokenizer, end_tokens), "lengths"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: docs_over (longer than ``limit``) and total tokens if cut at ``limit``
    (any limit, also one that is no document's length)."""
    over = F.col("n_tokens") > limit
    return sums.agg(F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
                    F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")).alias("truncated_total"))


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """One row: the least length that at least ``share`` of the documents do not exceed."""
    return sums.where(F.col("share_le") >= share).agg(F.min("n_tokens").alias("n_tokens"))
