"""Substring dedup by hashing lines and the sentences in them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from scrivenry.functions.arrays import running
from scrivenry.llm.batches import map_batches, slices
from scrivenry.llm.licenses import normal_words
from scrivenry.sources.tables import materialise

#: A sentence ends at a line feed or after end marks; the pieces cover the text.
UNIT = re.compile(r"\n|[^\n.!?]*[.!?]+|[^\n.!?]+")
#: Words that the repeated sentences of a run need together for the run to go.
RUN_WORDS = 8
#: Bytes of a unit's digest: among 3 * 10**12 units (100 TB) about 0.0001 pairs of different ones are expected to be equal.
DIGEST = 12
#: White space at the ends of a line; a line of nothing else is empty.
BLANK = " \t\r\v\f"


def line_units(text: str) -> list[tuple[int, int, int, int, bool, str]]:
    """(at, start, end, words, line, normal form) of every non-empty line and every sentence with words.

    ``at`` counts the sentences of the text and is -1 for units that are none: lines of several sentences
    and lines without words, whose normal form is what stands between their white space. A line in which
    only one sentence has words is one unit, line and sentence at once.
    """
    out, at, start = [], 0, 0
    for line in text.split("\n"):
        end = start + len(line)
        bare = line.strip(BLANK)
        if bare:
            parts = [(m.start(), m.end(), w) for m in UNIT.finditer(line) if (w := normal_words(m[0]))]
            if len(parts) == 1:
                parts = [(0, len(line), parts[0][2])]
            else:
                words = [w for p in parts for w in p[2]]
                out.append((-1, start, end, len(words), True, " ".join(words) or bare))
            for a, b, words in parts:
                out.append((at, start + a, start + b, len(words), len(parts) == 1, " ".join(words)))
                at += 1
        start = end + 1
    return out


def _units(docs: DataFrame, id_col: str, text_col: str, row: str) -> DataFrame:
    """(doc, row, at, start, end, words, line, digest) of ``line_units``, written once."""
    src = docs.select(F.col(id_col).alias("doc"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    kind = src.schema["doc"].dataType.simpleString()

    def run(batches):
        import xxhash

        for b in slices(batches, megabytes=4):
            own, cols = [], ([], [], [], [], [], [])
            for at, t in enumerate(b.column(2)):
                for *unit, form in line_units(t.as_py() or ""):
                    own.append(at)
                    for c, x in zip(cols, (*unit, xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass"))[:DIGEST])):
                        c.append(x)
            take = pa.array(own, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), *(pa.array(c, pa.int32()) for c in cols[:4]),
                 pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.binary())],
                names=["doc", "row", "at", "start", "end", "words", "line", "digest"])

    return materialise(map_batches(
        src, run, f"doc {kind}, row bigint, at int, start int, end int, words int, line boolean, digest binary"), "units", "zstd")


def repeated_spans(
    docs: DataFrame, row: str, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS,
) -> DataFrame:
    """(row, n_removed, spans): for each row of ``docs`` with repeats, its spans (start, end, first_doc).

    Units are equal where their normal words are (96-bit digest). Of equal units the one with the smallest
    (key, row, place) stays, null keys last. Every later occurrence of a non-empty line goes, whatever its
    words. Of sentences, repeats of any length that follow each other form a run, and runs of ``run_words``
    words or more go too. Spans are code points of the original text; those that overlap are one, and
    ``first_doc`` holds what stays of a span's first unit.

    Units are made once. The earliest of each digest is a partial minimum, so a line that is everywhere costs
    one row for each task; digests that occur once never reach the join, whose sides are both plain
    exchanges that adaptive execution can split where a digest is hot.
    """
    units = _units(docs, id_col, text_col, row)
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "row", "start")
    first = materialise(
        units.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("digest").alias("d"), "first"), "first-units")
    # what is shuffled of a unit is its digest and three numbers
    pair = lambda high, low: F.shiftleft(high.cast("bigint"), 32) + low
    narrow = units.select(
        "digest", "row", pair(F.col("start"), F.col("end")).alias("span"), pair(F.col("at"), F.col("words") * 2 + F.col("line").cast("int")).alias("unit"))
    high, low = (lambda c: F.shiftright(c, 32).cast("int")), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    again = narrow.join(first, F.col("digest") == F.col("d")).where(
        (F.col("row") != F.col("first.row")) | (high("span") != F.col("first.start"))
    ).select(
        "row", high("unit").alias("at"), high("span").alias("start"), low("span").cast("int").alias("end"),
        F.shiftright(low("unit"), 1).cast("int").alias("words"), (low("unit").bitwiseAND(F.lit(1)) == 1).alias("line"), F.col("first.doc").alias("first_doc"))
    sentence = F.col("at") >= 0
    own = Window.partitionBy("row", sentence).orderBy("at")
    before = Window.partitionBy("row").orderBy("start", "end", "long")
    runs = (
        again.repartition("row")
        .withColumn("run", F.when(sentence, F.col("at") - F.row_number().over(own)))
        .withColumn("long", sentence & (F.sum("words").over(Window.partitionBy("row", "run")) >= run_words))
        .where("long or line")
        .groupBy("row", "long", F.when(F.col("long"), F.col("run")).otherwise(F.col("start")).alias("part")).agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.min_by("first_doc", "start").alias("first_doc"))
    )
    merged = (
        runs.withColumn("reach", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("span", F.count_if(F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "span").agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.min_by("first_doc", F.struct("start", "end", "long")).alias("first_doc"))
    )
    return merged.groupBy("row").agg(
        F.sum("n").alias("n_removed"), F.array_sort(F.collect_list(F.struct("start", "end", "first_doc"))).alias("spans"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "kept_text", run_words: int = RUN_WORDS,
) -> DataFrame:
    """``docs`` with ``out`` (the text without its repeated spans; null stays null), ``n_removed`` and ``spans``.

    Rows are told apart by their place in the scan, which must be one that can be repeated, as of a table of
    files: of repeated rows one keeps its units and the others lose them all. Null and empty texts have
    no units; an empty table gives no rows; very long texts cost their length. Columns named like the
    three new ones, __row or __at are replaced or dropped, others stay.
    """
    src = docs.drop("n_removed", "spans", *({out} - {text_col}), "__row", "__at").withColumn("__row", F.monotonically_increasing_id())
    spans = repeated_spans(src, "__row", id_col, text_col, run_words).withColumnRenamed("row", "__at")
    found = src.join(spans, F.col("__row") == F.col("__at"), "left")
    text = F.col(text_col)

    def step(at, x):
        return x["end"], F.array(text.substr(at + 1, x["start"] - at))

    last = F.get("spans", F.size("spans") - 1)["end"]
    cut = F.concat(F.array_join(running(F.col("spans"), F.lit(0), "string", step), ""), text.substr(last + 1, F.length(text)))
    kind = spans.schema["spans"].dataType.simpleString()
    return (
        found.withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("bigint")))
        .withColumn("spans", F.coalesce("spans", F.array().cast(kind)))
        .withColumn(out, F.when(F.size("spans") > 0, cut).otherwise(text))
        .drop("__row", "__at")
    )


def op2(docs: DataFrame) -> DataFrame:
    """One row for each document: where its first repeat is kept (null: nothing goes), units removed, spans as
    start:end:first doc_id, digest of what stays."""
    found = remove_repeats(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", F.get("spans", F.lit(0))["first_doc"].alias("first_doc_id"), "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]).cast("long")).alias("removed_chars"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(
            ":", x["start"].cast("string"), x["end"].cast("string"), F.coalesce(x["first_doc"].cast("string"), F.lit("")))), ",").alias("spans"),
        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP2_SQL = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, r, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS pos FROM (SELECT doc_id, r, string_split(text, chr(10)) AS p FROM docs)
), lines AS (
  SELECT doc_id, r, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
         trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare,
         regexp_extract_all(line, '[^.!?]*[.!?]+|[^.!?]+') AS p
  FROM split
), pieces AS (
  SELECT doc_id, r, s, len, piece, n, s + coalesce(sum(length(piece)) OVER (PARTITION BY r, s ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ps
  FROM (SELECT doc_id, r, s, length(line) AS len, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS n FROM lines WHERE bare <> '')
), worded AS (
  SELECT doc_id, r, s, len, ps, length(piece) AS size, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM pieces
), sentences AS (
  SELECT *, count(*) OVER (PARTITION BY r, s) AS parts FROM worded WHERE len(w) > 0
), counts AS (
  SELECT r, s, count(*) AS parts FROM worded WHERE len(w) > 0 GROUP BY r, s
), whole AS (
  SELECT doc_id, r, s, length(line) AS len, bare, parts,
         array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ' ') AS form
  FROM lines LEFT JOIN counts USING (r, s) WHERE bare <> ''
), units AS (
  SELECT doc_id, r, -1 AS num, CAST(s AS BIGINT) AS s, CAST(s + len AS BIGINT) AS e, 0 AS words, true AS line, CASE WHEN form = '' THEN bare ELSE form END AS form
  FROM whole WHERE parts IS NULL OR parts > 1
  UNION ALL
  SELECT doc_id, r, row_number() OVER (PARTITION BY r ORDER BY ps) - 1, CAST(CASE WHEN parts = 1 THEN s ELSE ps END AS BIGINT),
         CAST(CASE WHEN parts = 1 THEN s + len ELSE ps + size END AS BIGINT), len(w), parts = 1, array_to_string(w, ' ')
  FROM sentences
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY form ORDER BY doc_id NULLS LAST, r, s) AS k,
         first_value(doc_id) OVER (PARTITION BY form ORDER BY doc_id NULLS LAST, r, s) AS first_doc
  FROM units
), runs AS (
  SELECT *, num >= 0 AND sum(words) OVER (PARTITION BY r, run) >= 8 AS long
  FROM (SELECT *, CASE WHEN num >= 0 THEN num - row_number() OVER (PARTITION BY r, num >= 0 ORDER BY num) END AS run FROM ranked WHERE k > 1)
), gone AS (
  SELECT r, long, min(s) AS s, max(e) AS e, count(*) AS n, arg_min(first_doc, s) AS first_doc
  FROM runs WHERE long OR line GROUP BY r, long, CASE WHEN long THEN run ELSE s END
), marked AS (
  SELECT *, coalesce(max(e) OVER (PARTITION BY r ORDER BY s, e, long ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= s, true) AS opens FROM gone
), merged AS (
  SELECT r, min(s) AS s, max(e) AS e, sum(n) AS n, arg_min(first_doc, (s * 10000000000 + e) * 2 + CAST(long AS INTEGER)) AS first_doc
  FROM (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY r ORDER BY s, e, long ROWS UNBOUNDED PRECEDING) AS span FROM marked) GROUP BY r, span
), found AS (
  SELECT r, sum(n) AS n_removed, count(*) AS n_spans, sum(e - s) AS removed_chars,
         string_agg(s || ':' || e || ':' || coalesce(CAST(first_doc AS VARCHAR), ''), ',' ORDER BY s) AS spans, arg_min(first_doc, s) AS first_doc_id, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es
  FROM merged GROUP BY r
)
SELECT doc_id, first_doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars, coalesce(spans, '') AS spans,
       sha256(CASE WHEN ss IS NULL THEN text ELSE
         array_to_string(list_transform(range(1, len(ss) + 2), lambda i:
           substr(text, 1 + CAST(CASE WHEN i = 1 THEN 0 ELSE es[i - 1] END AS INTEGER),
                  CAST((CASE WHEN i > len(ss) THEN length(text) ELSE ss[i] END) - (CASE WHEN i = 1 THEN 0 ELSE es[i - 1] END) AS INTEGER))), '')
       END) AS kept_sha256
FROM docs LEFT JOIN found USING (r)
"""
