"""Query registry of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scrivenry.plans import document_queries, fixture_queries, paper_queries, sink_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**document_queries.QUERIES, **fixture_queries.QUERIES, **sink_queries.QUERIES, **paper_queries.QUERIES}
ORACLES: dict[str, str] = {**document_queries.ORACLES, **fixture_queries.ORACLES, **sink_queries.ORACLES, **paper_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its chunks, its identity class and whether its text passes."""
    stats = QUERIES["run_stats"](spark, sf_dir)
    classes = QUERIES["dup_risk_documents"](spark, sf_dir)
    low = QUERIES["low_text"](spark, sf_dir)
    return (
        low.join(classes, "doc_id").join(stats, "doc_id", "left")
        .withColumn("gate", F.when((F.col("exit_code") == 0) & (F.col("doc_id") == F.col("class_id")), "pass").otherwise("failed"))
    )
