"""The operators as queries over the given tables, and their SQL where SQL says it."""

from __future__ import annotations

from partcast.llm import (
    embeddings, merkle, mixing, near_duplicates, packing, pii, quality, secret_scan, suffix_dedup, token_counts, token_files, urls,
    whitening,
)
from partcast.llm.base import table


def _documents(run):
    return lambda spark, sf_dir: run(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": _documents(quality.judge),
    "op2_suffix_dedup": _documents(suffix_dedup.judge),
    "op3_source_mixing": _documents(mixing.mix),
    "op4_best_fit_packing": _documents(packing.pack_documents),
    "op5_token_files": _documents(token_files.round_trip),
    "op6_url_filters": lambda spark, sf_dir: urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")),
    "op7_minhash_near_dedup": _documents(near_duplicates.judge),
    "op8_pii": _documents(pii.judge),
    "op9_embedding_near_dedup": lambda spark, sf_dir: embeddings.judge(table(spark, sf_dir, "embeddings")),
    "op10_token_counts": _documents(token_counts.context_table),
    "op11_merkle_manifest": _documents(merkle.prove),
    "op12_embedding_whitening": lambda spark, sf_dir: whitening.whiten(table(spark, sf_dir, "embeddings")),
    "op13_secret_scan": _documents(secret_scan.judge),
}

ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op2_suffix_dedup": suffix_dedup.ORACLE,
    "op6_url_filters": urls.ORACLE,
    "op7_minhash_near_dedup": near_duplicates.ORACLE,
    "op9_embedding_near_dedup": embeddings.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
