"""Benchmark decontamination by normalised word windows (DataFrame functions only)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from scrivenry.functions.arrays import bind, running
from scrivenry.sources.tables import materialise

#: Windows of the benchmark whose 64-bit hashes (8 bytes each) are broadcast at once; more are taken in blocks.
BROADCAST_WINDOWS = 4_000_000
#: Measured bytes of a table that may be broadcast; beyond them its join shuffles.
BROADCAST_BYTES = 64 << 20
#: Bits of the constant array before the hash set, which is left out where a window has fewer than LEAST_BITS.
MAX_LOG_BITS, LEAST_BITS = 23, 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none.

    ``lower`` equals the ASCII rule on texts of ASCII alone and is much cheaper there.
    """
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )
    return F.coalesce(
        F.filter(F.split(folded, SEPARATORS, -1), lambda w: w != ""), F.array().cast("array<string>")
    )


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _window(codes: Column, i: Column, n: int) -> Column:
    """Hash of the ``n`` word hashes from ``i`` on."""
    return F.xxhash64(*[F.get(codes, i + k) for k in range(n)])


def _quads(codes: Column) -> Column:
    return F.transform(codes, lambda c, i: F.xxhash64(c, F.get(codes, i + 1), F.get(codes, i + 2), F.get(codes, i + 3)))


def _long_window(quads: Column, codes: Column, i: Column, n: int) -> Column:
    """The same for n >= 4, from hashes of four words each and the words left over."""
    whole = n // 4 * 4
    return F.xxhash64(
        *[F.get(quads, i + k) for k in range(0, whole, 4)], *[F.get(codes, i + k) for k in range(whole, n)]
    )


def _window_hash(codes: Column, quads: Column, i: Column, k: int, n: int) -> Column:
    return _long_window(quads, codes, i, k) if k == n >= 4 else _window(codes, i, k)


def benchmark_windows(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(k, phrase, h, ids): every distinct window with its hash and the items that hold it.

    k is its number of words: ``n``, or all words of a shorter item. Items of no words (null,
    empty) give none.
    """
    words = items.select(F.col(id_col).cast("string").alias("id"), normal_words(F.col(text_col)).alias("w"))
    windows = words.where("size(w) > 0").select(
        "id", F.least(F.size("w"), F.lit(n)).alias("k"),
        F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))),
            lambda i: F.array_join(F.slice("w", i, n), " "))).alias("phrase"),
    )
    distinct = windows.groupBy("k", "phrase").agg(F.collect_set("id").alias("ids"))
    coded = distinct.withColumn("c", _hashes(F.split("phrase", " "))).withColumn("q", _quads(F.col("c")))
    h = F.coalesce(*[
        F.when(F.col("k") == k, _window_hash(F.col("c"), F.col("q"), F.lit(0), k, n)) for k in range(1, n + 1)])
    return coded.select("k", "phrase", h.alias("h"), "ids")


def _filter_bits(windows: DataFrame, log_bits: int) -> Column:
    """Constant array<bigint> of 2**log_bits bits, set where a window's hash falls.

    Its cells pass through the driver; MAX_LOG_BITS bounds them at 1 MB.
    """
    slot = F.col("h").bitwiseAND(F.lit((1 << log_bits) - 1))
    cells = windows.select(slot.alias("s")).groupBy((F.shiftright("s", 6)).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    )
    found = {r["cell"]: r["bits"] for r in cells.collect()}
    return F.from_json(F.lit(json.dumps([found.get(i, 0) for i in range(1 << (log_bits - 6))])), "array<bigint>")


def _text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(7), text).alias("__b")]


def find_hits(
    docs: DataFrame, items: DataFrame, n: int = 13, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(__a, __b, hits, item_ids): one row for each text that holds windows, by the key of the text.

    Windows of a document are hashed in place. A constant bit array drops most of them; the others are
    looked up in the broadcast set of the benchmark's hashes, in blocks of BROADCAST_WINDOWS, so what a
    task holds is bounded whatever the benchmark has. What is found there, true hits but for equal
    64-bit hashes, is verified by its words and gathered by text: documents are never shuffled, only hits.
    """
    windows = materialise(benchmark_windows(items, n, id_col, item_text_col), "windows")
    about = windows.agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("k").alias("ks"),
        F.sum(F.octet_length("phrase") + F.aggregate("ids", F.lit(0), lambda s, x: s + F.octet_length(x) + 16) + 64).alias("bytes")).first()
    kinds = "array<struct<start:int,end:int>>"
    ks = sorted(about["ks"], reverse=True)
    words = docs.select(*_text_key(F.col(text_col)), normal_words(F.col(text_col)).alias("__w"))
    if not about["n"]:
        return words.select("__a", "__b", F.array().cast(kinds).alias("hits"), F.array().cast("array<string>").alias("item_ids")).where("false")
    coded = words.withColumn("__c", _hashes(F.col("__w")))
    coded = coded.withColumn("__q", _quads(F.col("__c")) if n in ks and n >= 4 else F.col("__c"))
    size = F.size("__w")

    def hashed(k: int) -> Column:
        starts = F.when(size >= k, F.sequence(F.lit(0), size - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(
            F.lit(k).alias("k"), i.alias("start"), _window_hash(F.col("__c"), F.col("__q"), i, k, n).alias("h")))

    found = F.flatten(F.array(*[hashed(k) for k in ks])) if len(ks) > 1 else hashed(ks[0])
    log_bits = min(MAX_LOG_BITS, max(12, (512 * about["n"] - 1).bit_length()))
    if LEAST_BITS * about["n"] <= 1 << log_bits:
        bits = _filter_bits(windows, log_bits)
        mask = F.lit((1 << log_bits) - 1)
        found = F.filter(found, lambda x: F.getbit(
            F.get(bits, F.shiftright(x["h"].bitwiseAND(mask), 6).cast("int")), x["h"].bitwiseAND(F.lit(63)).cast("int")) == 1)
    places = coded.select("__a", "__b", "__w", F.explode(found).alias("m"))
    blocks = -(-about["n"] // max(1, BROADCAST_WINDOWS))
    block = F.pmod(F.xxhash64("h", F.lit(3)), F.lit(blocks))
    met = None
    for i in range(blocks):
        known = F.broadcast(windows.where(block == i).select(F.col("h").alias("__h")).distinct())
        part = places.join(known, F.col("m.h") == F.col("__h"), "left_semi")
        met = part if met is None else met.union(part)
    hit = met.select("__a", "__b", F.col("m.start").alias("start"), F.col("m.k").alias("k"), F.array_join(
        F.slice("__w", F.col("m.start") + 1, F.col("m.k")), " ").alias("phrase"))
    known = windows.select(F.col("phrase").alias("__phrase"), F.col("k").alias("__k"), "ids")
    if about["bytes"] <= BROADCAST_BYTES:
        known = F.broadcast(known)
    verified = hit.join(known, (F.col("phrase") == F.col("__phrase")) & (F.col("k") == F.col("__k")))
    gathered = verified.groupBy("__a", "__b").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("k")).alias("end")))).alias("h"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        joins = x["start"] <= s["end"]
        state = F.struct(F.when(joins, s["start"]).otherwise(x["start"]).alias("start"), F.greatest(s["end"], x["end"]).alias("end"))
        return state, F.when(joins, F.array().cast(kinds)).otherwise(F.array(s))

    # the first interval opens the fold, so none is empty
    merged = running(
        F.slice("h", 2, F.size("h")), F.get("h", F.lit(0)), "struct<start:int,end:int>", step, lambda s: F.array(s))
    return gathered.select("__a", "__b", merged.alias("hits"), "item_ids")


def _with_hits(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the columns of ``found`` (null: none): by broadcast where they are measured to be small."""
    found = materialise(found, "hits")
    hits, ids = found.columns[2:]
    size = found.agg(F.sum(F.size(hits) * 8 + 64 + F.aggregate(
        ids, F.lit(0), lambda s, x: s + F.octet_length(x) + 16)).alias("n")).first()["n"] or 0
    placed = docs.select("*", *_text_key(F.col(text_col)))
    return placed.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, ["__a", "__b"], "left").drop("__a", "__b")


def find_contamination(
    docs: DataFrame, items: DataFrame, n: int = 13, text_col: str = "text", id_col: str = "item_id",
    item_text_col: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all where None) with ``n_words``, ``hits`` (word intervals [start, end), merged) and ``item_ids``.

    Two passes over the documents, see ``find_hits``: the first finds the hits, the second joins them
    back by the text's key, by broadcast up to BROADCAST_BYTES measured bytes. Null and empty documents,
    and an empty benchmark, give no hits; repeated documents are judged each on its own; repeated items
    share their windows; very long texts cost their length. Columns of ``docs`` named n_words, hits or
    item_ids are replaced, other columns (benchmark names included) stay.
    """
    keep = [c for c in carry or docs.columns if c not in ("n_words", "hits", "item_ids")]
    src = docs.select(*dict.fromkeys([*keep, text_col]))
    out = _with_hits(src, find_hits(docs, items, n, text_col, id_col, item_text_col), text_col)
    return out.select(
        *keep, F.size(normal_words(F.col(text_col))).cast("long").alias("n_words"),
        F.coalesce("hits", F.array().cast("array<struct<start:int,end:int>>")).alias("hits"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def covered(hits: Column) -> Column:
    """Number of words inside merged intervals."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]).cast("long"))


WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def cut_words(text: Column, hits: Column) -> Column:
    """``text`` without the words of the intervals ``hits`` and without what parts them from the word before.

    ``hits`` are in order and do not overlap. A text without hits comes back as it is, null stays null.
    """
    def kept(parts: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(hits, i - 1)["end"])
        cut = F.transform(hits, lambda h, i: F.array_join(F.slice(parts, before(i) + 1, h["start"] - before(i)), ""))
        last = F.get(hits, F.size(hits) - 1)["end"]
        return F.concat(F.array_join(cut, ""), F.array_join(F.slice(parts, last + 1, F.size(parts)), ""))

    parts = F.transform(
        F.arrays_zip(F.split(text, WORD, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("word")),
        lambda p: F.concat(p["gap"], F.coalesce(p["word"], F.lit(""))))
    return F.when(F.size(hits) > 0, bind(parts, kept)).otherwise(text)


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13) -> DataFrame:
    """``docs`` without contaminated documents and, in the others, without the benchmark's words.

    Returns the columns of ``docs``; a column n_chars follows a changed text. Texts without hits are
    neither split into words again nor changed; an empty benchmark or table changes nothing.
    """
    found = _with_hits(docs.select(*[F.col(c).alias(f"__d{i}") for i, c in enumerate(docs.columns)], F.col("text").alias("__t")),
                       find_hits(docs, items, n).withColumnsRenamed({"hits": "__h", "item_ids": "__i"}), "__t")
    hit = F.col("__h").isNotNull()
    bad = F.when(hit, contaminated(covered(F.col("__h")), F.size(normal_words(F.col("__t"))))).otherwise(False)
    text = F.when(hit, cut_words(F.col("__t"), F.col("__h"))).otherwise(F.col("__t"))
    out = found.where(~bad).withColumn("__t", text)
    columns = [F.col("__t").alias(c) if c == "text" else F.when(hit, F.length("__t").cast("bigint")).otherwise(F.col(f"__d{i}")).alias(c)
               if c == "n_chars" else F.col(f"__d{i}").alias(c) for i, c in enumerate(docs.columns)]
    return out.select(*columns)


def op4(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contract rows of op4."""
    found = find_contamination(docs, items, carry=["doc_id"]).withColumn("n_hit", covered(F.col("hits")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT id, least(len(w), 13) AS k,
         array_to_string(w[i:i + 12], ' ') AS phrase
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k)
), hits AS (
  SELECT p.r, p.i, p.k, x.id FROM places p JOIN windows x ON p.phrase = x.phrase AND p.k = x.k
), covered AS (
  SELECT r, count(DISTINCT j) AS n_hit
  FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
