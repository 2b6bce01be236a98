"""Excerpts located in texts: candidate pairs by an equi-join, places by the full rule of normalisation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from scrivenry.functions import text as X
from scrivenry.sources.batches import map_batches

#: Whole words in a row that a text must share with an excerpt before the two are compared, at most.
ANCHOR_WORDS = 3
#: Anchors (24 bytes each) that may be broadcast; beyond that the join shuffles.
BROADCAST_ITEMS = 1_000_000
#: Excerpts of one or two words, which have no whole inner word, that meet the texts at once.
SHORT_BLOCK = 10_000


def _grams(words: Column, k: int) -> Column:
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])
    )).otherwise(F.array().cast("array<bigint>"))


def candidate_pairs(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) that may hold: all true pairs are among them.

    ``texts`` has (doc_id, hay), ``items`` has (item_id, needle), both normalised. An excerpt can begin
    and end inside a word, but its inner words are whole words of the text, so the first of them (three
    at most) are an equi-join key. An excerpt without an inner word is looked for in every text, in
    blocks of SHORT_BLOCK excerpts, which are a stated query set.
    """
    words = F.split("needle", " ")
    inner = F.least(F.size(words) - 2, F.lit(ANCHOR_WORDS))
    anchor = F.coalesce(*[
        F.when(inner == k, F.xxhash64(F.lit(k), *[F.get(words, F.lit(j + 1)) for j in range(k)])) for k in range(1, ANCHOR_WORDS + 1)])
    sized = items.select("item_id", "needle", inner.alias("k"), anchor.alias("anchor"))
    counts = {r["k"]: r["n"] for r in sized.groupBy(F.greatest("k", F.lit(0)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    anchored = sized.where("k >= 1").select("item_id", "anchor")
    if sum(counts.values()) <= BROADCAST_ITEMS:
        anchored = F.broadcast(anchored)
    parted = texts.select("doc_id", F.split("hay", " ").alias("w"))
    grams = F.concat(*[_grams(F.col("w"), k) for k in sorted(counts) if k]) if any(counts) else F.array().cast("array<bigint>")
    found = parted.select("doc_id", F.explode(F.array_distinct(grams)).alias("anchor")).join(
        anchored, "anchor").select("doc_id", "item_id")
    short = sized.where("k < 1")
    blocks = -(-counts.get(0, 0) // SHORT_BLOCK)
    for b in range(blocks):
        part = short.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "needle")
        found = found.union(texts.join(F.broadcast(part), F.contains("hay", F.col("needle"))).select("doc_id", "item_id"))
    return found.distinct()


def locate(evidence: DataFrame, contents: DataFrame, key: str = "source_id") -> DataFrame:
    """``evidence`` with ``start`` and ``end``: code points of the original content, null where it is not found.

    ``evidence`` has ``key``, ``excerpt`` and, for a preferred range, ``pref_start`` and ``pref_end`` (null: none);
    ``contents`` has ``key`` and ``content``, one row each. Excerpt and content are compared in NFKC, case-folded,
    without emphasis marks and with blanks collapsed; a hit inside the preferred range wins, else the first;
    hits inside an omission marker do not count. Each content is normalised once at most, and only where an excerpt does
    not stand at the start of its preferred range: the evidence of one source, which its chunks bound, meets it in one row. Null or empty excerpts and unknown keys are not found.
    """
    rest = [c for c in evidence.columns if c not in ("start", "end", "pref_start", "pref_end")]
    bound = [F.col(c).cast("bigint") if c in evidence.columns else F.lit(None).cast("bigint") for c in ("pref_start", "pref_end")]
    kept = evidence.select(*rest, bound[0].alias("pref_start"), bound[1].alias("pref_end"))
    grouped = kept.groupBy(F.col(key).alias("__key")).agg(F.collect_list(F.struct(*kept.columns)).alias("e"))
    joined = grouped.join(contents.select(F.col(key).alias("__c"), "content"), F.col("__key") == F.col("__c"), "left").select("e", "content")
    schema = StructType([*kept.select(*rest).schema.fields, StructField("start", LongType()), StructField("end", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                content, hay = b.column(1)[i].as_py(), None
                dead = X.omissions(content) if content else []
                for e in b.column(0)[i].as_py():
                    a, z = e.pop("pref_start"), e.pop("pref_end")
                    preferred = None if a is None or z is None else (a, z)
                    at = X.locate_at_start(e["excerpt"], content, dead, preferred)
                    if at is None and content:
                        hay = hay or X.normal_with_map(content)
                        at = X.locate_normal(e["excerpt"], hay, dead, preferred)
                    rows.append({**e, "start": at[0] if at else None, "end": at[1] if at else None})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return map_batches(joined, run, schema)
