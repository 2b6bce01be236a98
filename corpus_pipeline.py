"""Corpus pipeline: documents -> good, distinct, clean, redacted documents -> token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scrivenry.llm import bpe, decontaminate, quality, secrets, simhash
from scrivenry.sources.tables import materialise, table

#: Near-duplicate stage: sets of 5-word shingles of an exact Jaccard similarity of 0.8. The SimHash of 512 bits
#: only finds candidates: two sets of similarity 0.8 differ in about 77 bits (spread 8; up to about 96 where
#: sets are tiny), unrelated texts in about 256 (spread 11).
NEAR = {"shingle": 5, "words": 8, "radius": 144, "n_anchors": 8, "similarity": 0.8}


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject (score 0.3 or more)."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, machine)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates of similarity 0.8 or more."""
    return simhash.keep_one(docs, **NEAR)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: contaminated ones go, lesser passages are cut out."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced."""
    return secrets.redact_secrets(docs, secrets.train(secrets.labelled_samples(spark)))


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return bpe.digests(coded).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", distinct_documents),
    ("benchmark decontamination", uncontaminated_documents),
    ("secret scan", redacted_documents),
    ("byte-level bpe", encoded_documents),
]

#: Fingerprints, a fitted machine and byte-pair merges are not SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
