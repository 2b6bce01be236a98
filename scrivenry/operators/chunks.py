"""Blocks and chunks of a text with code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from scrivenry import config as C
from scrivenry.functions.arrays import bind, cut, running

BLOCK = "array<struct<start:int,end:int>>"
CHUNK = "array<struct<start:int,end:int,blocks:int>>"


def line_blocks(text: Column) -> Column:
    """Non-empty lines as array<struct(start, end)>, offsets from 0, end exclusive.

    A line feed parts blocks; positions come from a running sum over the lines' lengths.
    """
    def step(at, n):
        return at + n + 1, F.when(n > 0, F.array(F.struct(at.alias("start"), (at + n).alias("end")))).otherwise(F.array().cast(BLOCK))

    return running(F.transform(F.split(text, "\n", -1), lambda x: F.length(x)), F.lit(0), "struct<start:int,end:int>", step)


def split_oversize(blocks: Column, limit: int = C.CHUNK_CHARS) -> Column:
    """Blocks longer than ``limit`` cut every ``limit`` characters."""
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((b["end"] - b["start"] - 1) / limit), F.lit(0)).cast("int")),
        lambda i: F.struct((b["start"] + i * limit).alias("start"), F.least(b["start"] + (i + 1) * limit, b["end"]).alias("end")))))


def pack_blocks(blocks: Column, limit: int = C.CHUNK_CHARS, overlap: int = 0) -> Column:
    """Greedy packing: a block joins the open chunk while the chunk's span stays within ``limit``.

    With ``overlap``, a new chunk starts with the last block of the one before where that block has at
    most ``overlap`` characters and both fit (whole blocks only).
    """
    none = F.array().cast(CHUNK)
    done = lambda s: F.when(s["start"] < 0, none).otherwise(
        F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["blocks"].alias("blocks"))))

    def step(s, b):
        fits = (s["start"] >= 0) & (b["end"] - s["start"] <= limit)
        carry = (s["last"] >= 0) & (b["start"] - s["last"] <= overlap + 1) & (s["end"] - s["last"] <= overlap) & (
            b["end"] - s["last"] <= limit) & (s["last"] > s["start"]) if overlap else F.lit(False)
        opened = F.when(carry, s["last"]).otherwise(b["start"])
        state = F.struct(
            F.when(fits, s["start"]).otherwise(opened).alias("start"), b["end"].alias("end"),
            F.when(fits, s["blocks"] + 1).otherwise(F.when(carry, F.lit(2)).otherwise(F.lit(1))).alias("blocks"),
            b["start"].alias("last"))
        return state, F.when(fits, none).otherwise(done(s))

    zero = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(0).alias("blocks"), F.lit(-1).alias("last"))
    return running(blocks, zero, "struct<start:int,end:int,blocks:int>", step, done)


def blocks(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, ord, start, end, text): one row for each block, ord from 1. A narrow projection, linear in the text."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: x != "")
    found = F.arrays_zip(line_blocks(F.coalesce(F.col(text_col), F.lit(""))).alias("at"), lines.alias("line"))
    return df.select(id_col, F.posexplode(found).alias("p", "b")).select(
        id_col, (F.col("p") + 1).cast("bigint").alias("ord"), F.col("b.at.start").cast("bigint").alias("start"),
        F.col("b.at.end").cast("bigint").alias("end"), F.col("b.line").alias("text"))


def chunks(df: DataFrame, id_col: str, text_col: str = "text", limit: int = C.CHUNK_CHARS, overlap: int = 0) -> DataFrame:
    """(id, chunk_no, start, end, blocks, text): a document's chunks in order, in one projection."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    folded = pack_blocks(split_oversize(line_blocks(text), limit), limit, overlap)
    found = bind(folded, lambda spans: F.arrays_zip(spans.alias("at"), cut(text, spans).alias("text")))
    return df.select(id_col, F.posexplode(found).alias("p", "c")).select(
        id_col, (F.col("p") + 1).cast("bigint").alias("chunk_no"), F.col("c.at.start").cast("bigint").alias("start"),
        F.col("c.at.end").cast("bigint").alias("end"), F.col("c.at.blocks").cast("bigint").alias("blocks"), F.col("c.text").alias("text"))


def numbered(df: DataFrame, by: str, *order: str) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))
