"""Queries of the training-data operators."""

from __future__ import annotations

from scrivenry.llm import bpe, decontaminate, embeddings, licenses, quality, secrets, sharding, simhash, substrings, token_files
from scrivenry.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


QUERIES = {
    "op2_substring_dedup": lambda spark, d: substrings.op2(_docs(spark, d)),
    "op3_byte_bpe": lambda spark, d: bpe.op3(_docs(spark, d)),
    "op5_embedding_near_dedup": lambda spark, d: embeddings.op5(table(spark, d, "embeddings")),
    "op9_token_files": lambda spark, d: token_files.op9(_docs(spark, d)),
    "op8_quality_classifier": lambda spark, d: quality.op8(_docs(spark, d), table(spark, d, "labels")),
    "op10_simhash_near_dedup": lambda spark, d: simhash.op10(_docs(spark, d)),
    "op1_secret_scan": lambda spark, d: secrets.op1(_docs(spark, d)),
    "op4_decontamination": lambda spark, d: decontaminate.op4(_docs(spark, d), table(spark, d, "benchmark")),
    "op6_license_scan": lambda spark, d: licenses.op6(_docs(spark, d)),
    "op7_sharding": lambda spark, d: sharding.op7(_docs(spark, d)),
}
ORACLES: dict[str, str] = {"op2_substring_dedup": substrings.OP2_SQL, "op4_decontamination": decontaminate.OP4_SQL}
