"""Corpus preparation: quality rules, near-duplicates, personal data, mixing, packing.

``STAGES`` run in order; each takes (spark, docs, sf_dir) and returns a DataFrame, which
``run`` writes as Parquet into the shared folder and reads again as the next one's docs.
All but the last return the columns of documents.

Defined results, by what a stage's operator defines (its module states every case): rows without
words, null and empty texts among them, fail the quality rules; texts of any length are read
whole in every stage; of repeated rows and near copies one row of the least doc_id stays, and
rows without a doc_id take no part in that; an empty table passes through as
one; extra columns, whatever their names, are carried to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partcast.llm import mixing, near_duplicates, packing, pii, quality
from partcast.llm.base import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_duplicates.keep(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, are replaced by their kinds."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and pass, with the words that the mix takes."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: Neither the signatures nor the tokenizer can be said in SQL; tests compare the stages
#: with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
