"""Coverage of method subsections by candidates, recovery targets and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from scrivenry import config as C
from scrivenry.functions import text as X

NO_NAMES = "array<string>"


def offset_chunks(subs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that overlap a subsection's span: equal source, then intervals."""
    c = chunks.select(F.col("source_id").alias("cs"), "chunk_no", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    return subs.join(c, (F.col("source_id") == F.col("cs")) & (F.col("c_start") < F.col("end")) & (F.col("start") < F.col("c_end")))


def heading_chunks(subs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with a heading line whose canonical form is the subsection's."""
    lines = chunks.select(F.col("source_id").alias("cs"), "chunk_no", F.explode(F.split("text", "\n")).alias("line")).where("line rlike '^#{1,6} '")
    named = lines.withColumn("c", X.heading_parts(F.col("line"))["canonical"]).select("cs", "chunk_no", "c").distinct()
    return subs.join(named, (F.col("source_id") == F.col("cs")) & (F.col("heading") == F.col("c")))


def evidence_cover(subs: DataFrame, cands: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source_id, sub_id, cand_id): covering roles with located evidence inside the span."""
    good = cands.where(F.col("role").isin(*C.COVERING_ROLES)).select("source_id", "cand_id")
    e = evidence.where("located").join(good, ["source_id", "cand_id"]).select(
        F.col("source_id").alias("es"), "cand_id", F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    return subs.join(e, (F.col("source_id") == F.col("es")) & (F.col("e_start") >= F.col("start")) & (F.col("e_end") <= F.col("end"))).select(
        "source_id", "sub_id", "cand_id").distinct()


def title_cover(subs: DataFrame, cands: DataFrame) -> DataFrame:
    """(source_id, sub_id, cand_id): covering roles whose title has the heading among its signatures."""
    good = cands.where(F.col("role").isin(*C.COVERING_ROLES))
    keyed = good.select("source_id", "cand_id", F.explode(X.signatures(F.col("title"), F.array().cast(NO_NAMES))).alias("key"))
    return subs.select("source_id", "sub_id", X.strip_wrappers(X.identity(F.col("heading"))).alias("key")).join(
        keyed, ["source_id", "key"]).select("source_id", "sub_id", "cand_id").distinct()


def uncovered(subs: DataFrame, cands: DataFrame, evidence: DataFrame) -> DataFrame:
    covered = title_cover(subs, cands).union(evidence_cover(subs, cands, evidence)).select("source_id", "sub_id").distinct()
    return subs.join(covered, ["source_id", "sub_id"], "left_anti")


def targets(open_subs: DataFrame) -> DataFrame:
    """At most eight subsections with a body for each source, in document order, with their chunk ids."""
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("start"))
    body = F.left("body", F.lit(C.CHUNK_CHARS))
    return (
        open_subs.where(F.col("body").rlike(r"\S")).withColumn("n", n).where(F.col("n") <= C.MAX_TARGETED)
        .withColumn("target_id", target_id(F.col("sub_id"), F.col("heading"), body)))


def target_id(sub_id: Column, heading: Column, body: Column) -> Column:
    return X.targeted_id(sub_id, F.concat(heading, F.lit("\n"), body))


def first_bodies(subs: Column, content: Column) -> Column:
    """array<struct(sub_id, heading, body)> of the first eight of ``subs`` (``headings.subsections``), bodies as ``targets`` cuts them."""
    def one(x: Column) -> Column:
        start = x["start"] + x["width"] + 1
        body = F.substr(content, (start + 1).cast("int"), F.least(x["end"] - start, F.lit(C.CHUNK_CHARS)).cast("int"))
        return F.struct(x["sub_id"].alias("sub_id"), x["heading"].alias("heading"), body.alias("body"))

    return F.transform(F.slice(subs, 1, C.MAX_TARGETED), one)
