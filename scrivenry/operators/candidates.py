"""Candidates: roles, duplicate groups, gate, curator, exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scrivenry import config as C
from scrivenry.functions import text as X
from scrivenry.operators.graph import connected_components


def keep_roles(cands: DataFrame) -> DataFrame:
    """Baselines and analyses go; data sets and metrics stay only as the source's own work."""
    return cands.where(~F.col("role").isin("baseline", "analysis") & (~F.col("role").isin("dataset", "metric") | F.col("own")))


def promote(cands: DataFrame, heading_chunk: DataFrame) -> DataFrame:
    """``role``: a method entity whose title is a heading inside its own chunk becomes a mechanism.

    ``cands`` has chunk_no, ``heading_chunk`` has (source_id, heading, chunk_no).
    """
    keys = heading_chunk.select("source_id", "chunk_no", X.strip_wrappers(X.identity(F.col("heading"))).alias("key")).distinct().withColumn("hit", F.lit(True))
    mine = cands.withColumn("key", X.strip_wrappers(X.identity(F.col("title"))))
    joined = mine.join(keys, ["source_id", "chunk_no", "key"], "left")
    return joined.withColumn("role", F.when(F.col("hit") & (F.col("role") == "method_entity"), "mechanism").otherwise(F.col("role"))).drop("hit", "key")


def is_generic(title: Column, primary: Column) -> Column:
    return primary | X.identity(title).isin(*C.GENERIC_TITLES)


def duplicate_links(cands: DataFrame, names: Column) -> DataFrame:
    """(source_id, cand_id, hub): a candidate and the smallest candidate that shares one of its signatures.

    Links to a hub span the group, so a signature that many share never becomes all its pairs.
    """
    keyed = cands.select("source_id", "cand_id", F.explode(X.signatures(F.col("title"), names)).alias("key"))
    hubs = keyed.groupBy("source_id", "key").agg(F.min("cand_id").alias("hub"))
    return keyed.join(hubs, ["source_id", "key"]).select("source_id", "cand_id", "hub").distinct()


def duplicate_groups(cands: DataFrame, names: Column) -> DataFrame:
    """(source_id, cand_id, group): members of groups of two or more; the group is its smallest member."""
    tag = lambda c: F.format_string("%019d/%019d", "source_id", c)
    links = duplicate_links(cands, names).select(tag("cand_id").alias("a"), tag("hub").alias("b"))
    found = connected_components(links)
    part = lambda c, n: F.split(c, "/")[n].cast("bigint")
    return found.select(part("node", 0).alias("source_id"), part("node", 1).alias("cand_id"), part("component", 1).alias("group"))


def gate(cands: DataFrame, groups: DataFrame) -> DataFrame:
    """(source_id, status, reasons) over the selected candidates; any reason fails the source."""
    left = groups.select("source_id", "cand_id", "group")
    s = cands.join(left, ["source_id", "cand_id"], "left")
    chosen = F.col("selected")
    a = s.groupBy("source_id").agg(
        F.count_if(chosen).alias("n"), F.count_if(chosen & F.col("primary")).alias("p"),
        (F.count_if(chosen & F.col("group").isNotNull()) - F.count_distinct(F.when(chosen, F.col("group")))).alias("dup"),
        F.count_if(F.col("role") == "mechanism").alias("m_all"), F.count_if(chosen & (F.col("role") == "mechanism")).alias("m"),
        F.count_if(chosen & is_generic(F.col("title"), F.col("primary"))).alias("g"))
    reasons = F.array_compact(F.array(
        F.when((F.col("n") > 0) & (F.col("p") > C.DOMINANCE * F.col("n")), "entity_dominance"), F.when(F.col("p") > 1, "several_primary_entities"),
        F.when(F.col("dup") > 0, "duplicate_risk"), F.when((F.col("m_all") > 0) & (F.col("m") == 0), "no_mechanism_selected"),
        F.when((F.col("n") > 0) & (F.col("g") == F.col("n")), "only_generic")))
    return a.select("source_id", F.when(F.size(reasons) > 0, "failed").otherwise("pass").alias("status"), F.array_join(reasons, ",").alias("reasons"))


def exit_code(failures: Column, low_text: Column, gate_failed: Column) -> Column:
    """Technical failures come before the quality gate (ours), refusal of scans before both."""
    return F.when(low_text, C.EXITS["ocr"]).when(failures > 0, C.EXITS["technical"]).when(gate_failed, C.EXITS["quality"]).otherwise(C.EXITS["ok"])
