"""Queries over documents, pages, benchmark, labels and conversations, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivenry import config as C
from scrivenry.functions import text as X
from scrivenry.operators import chunks as K, scan as R, view as L
from scrivenry.operators.locate import candidate_pairs, locate
from scrivenry.sources import pages as P
from scrivenry.sources.tables import table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents")


IDENT = "regexp_replace(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '^(a|an|the) ', '')"
NORMAL = "trim(regexp_replace(regexp_replace(lower({x}), '[*_`]', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
LINES = """
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, line, pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM lines
), blocks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord, CAST(s AS BIGINT) AS s, CAST(s + length(line) AS BIGINT) AS e, line
  FROM placed WHERE length(line) > 0
)"""
PIECES = LINES + """, pieces AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS n, s, e FROM (
    SELECT doc_id, s + i * 4000 AS s, least(s + (i + 1) * 4000, e) AS e
    FROM (SELECT doc_id, s, e, unnest(range(0, greatest((e - s - 1) // 4000, 0) + 1)) AS i FROM blocks))
)"""
FOLD = "WITH RECURSIVE " + PIECES + """, fold AS (
  SELECT doc_id, n, s AS start, e, 1 AS no, 1 AS blocks FROM pieces WHERE n = 1
  UNION ALL
  SELECT p.doc_id, p.n, CASE WHEN p.e - f.start <= 4000 THEN f.start ELSE p.s END, p.e,
         CASE WHEN p.e - f.start <= 4000 THEN f.no ELSE f.no + 1 END, CASE WHEN p.e - f.start <= 4000 THEN f.blocks + 1 ELSE 1 END
  FROM fold f JOIN pieces p ON p.doc_id = f.doc_id AND p.n = f.n + 1
), chunked AS (
  SELECT doc_id, CAST(no AS BIGINT) AS chunk_no, CAST(min(start) AS BIGINT) AS "start", CAST(max(e) AS BIGINT) AS "end", CAST(max(blocks) AS BIGINT) AS blocks
  FROM fold GROUP BY doc_id, no
)"""


@query(r"""SELECT page_id, sha256(x) AS escaped_sha256, CAST(length(x) AS BIGINT) AS n_chars FROM (SELECT page_id,
 replace(replace(replace(replace(html, '\<', '<'), '\>', '>'), '<', '&lt;'), '>', '&gt;') AS x FROM pages)""")
def escape_angle(spark, d):
    """F1"""
    x = table(spark, d, "pages").select("page_id", X.escape_angle(F.col("html")).alias("x"))
    return x.select("page_id", X.sha256(F.col("x")).alias("escaped_sha256"), F.length("x").cast("bigint").alias("n_chars"))


@query(f"SELECT doc_id, sha256({IDENT.format(x='text')}) AS identity_sha256 FROM documents")
def identity_norm(spark, d):
    """F2"""
    return docs(spark, d).select("doc_id", X.sha256(X.identity(F.col("text"))).alias("identity_sha256"))


@query(f"SELECT doc_id, {NORMAL.format(x='text')} AS normal FROM documents")
def excerpt_norm(spark, d):
    """F6, the part that SQL has"""
    return docs(spark, d).select("doc_id", X.normal_excerpt(F.col("text")).alias("normal"))


@query()
def excerpt_norm_full(spark, d):
    """F6 with NFKC and case folding"""
    return docs(spark, d).select("doc_id", X.normal_excerpt(X.nfkc(F.col("text"))).alias("normal"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    """F14"""
    return docs(spark, d).select("doc_id", X.sha256(F.col("text")).alias("content_hash"))


@query("WITH " + LINES + ' SELECT doc_id, ord, s AS "start", e AS "end", line AS text FROM blocks')
def doc_blocks(spark, d):
    """G1, W4"""
    return K.blocks(docs(spark, d), "doc_id")


@query(FOLD + """ SELECT c.doc_id, chunk_no, "start", "end", blocks, 'chunk-' || lpad(CAST(chunk_no AS VARCHAR), 4, '0') || '-' ||
 substr(sha256(substr(text, "start" + 1, "end" - "start")), 1, 16) AS chunk_id FROM chunked c JOIN documents USING (doc_id)""")
def doc_chunks(spark, d):
    """G2, G3, F9, L1, W5"""
    c = K.chunks(docs(spark, d), "doc_id")
    return c.select("doc_id", "chunk_no", "start", "end", "blocks", X.chunk_id(F.col("chunk_no"), F.col("text")).alias("chunk_id"))


@query("WITH RECURSIVE " + PIECES + """, fold AS (
  SELECT doc_id, n, s AS start, s AS last, e, 1 AS no, 1 AS blocks FROM pieces WHERE n = 1
  UNION ALL
  SELECT doc_id, n, CASE WHEN fits THEN start WHEN carry THEN last ELSE s END, s, e,
         CASE WHEN fits THEN no ELSE no + 1 END, CASE WHEN fits THEN blocks + 1 WHEN carry THEN 2 ELSE 1 END
  FROM (SELECT p.doc_id, p.n, p.s, p.e, f.start, f.last, f.no, f.blocks, p.e - f.start <= 4000 AS fits,
               p.s - f.last <= 201 AND f.e - f.last <= 200 AND p.e - f.last <= 4000 AND f.last > f.start AS carry
        FROM fold f JOIN pieces p ON p.doc_id = f.doc_id AND p.n = f.n + 1)
) SELECT doc_id, CAST(no AS BIGINT) AS chunk_no, CAST(min(start) AS BIGINT) AS "start", CAST(max(e) AS BIGINT) AS "end", CAST(max(blocks) AS BIGINT) AS blocks
  FROM fold GROUP BY doc_id, no""")
def chunk_overlap(spark, d):
    """G4"""
    return K.chunks(docs(spark, d), "doc_id", overlap=C.OVERLAP_CHARS).drop("text")


@query(FOLD + """ SELECT doc_id, CAST(length(any_value(text)) AS BIGINT) AS source_chars, count(*) AS chunks, round(avg("end" - "start"), 1) AS avg_chunk,
 CAST(max("end" - "start") AS BIGINT) AS max_chunk, count(*) + CASE WHEN count(*) > 12 THEN 1 ELSE 0 END AS llm_calls
 FROM chunked JOIN documents USING (doc_id) GROUP BY doc_id""")
def run_stats(spark, d):
    """A3, A4: one general call for each chunk and one curator call beyond twelve candidates"""
    c = K.chunks(docs(spark, d).select("doc_id", "text", F.length("text").alias("n")).withColumn("doc_id", F.struct("doc_id", "n")), "doc_id")
    n = F.count(F.lit(1))
    return c.groupBy("doc_id").agg(
        n.alias("chunks"), F.round(F.avg(F.col("end") - F.col("start")), 1).alias("avg_chunk"),
        F.max(F.col("end") - F.col("start")).alias("max_chunk"),
    ).select("doc_id.doc_id", F.col("doc_id.n").cast("bigint").alias("source_chars"), "chunks", "avg_chunk", "max_chunk",
             (F.col("chunks") + F.when(F.col("chunks") > C.MAX_CONCEPTS, 1).otherwise(0)).alias("llm_calls"))


CANON = "trim(regexp_replace(lower(trim(regexp_replace(regexp_replace(trim(regexp_replace(line, '^#{1,6} +', '')), '[*_`]', '', 'g'), '^[0-9]+(\\.[0-9]+)*\\.? ', ''))), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
KIND = r"""CASE WHEN starts_with(line, '> [... omitted from AI extraction') THEN 'omission' WHEN regexp_matches(line, '(?i)^(figure|fig\.) ?[0-9]') THEN 'caption'
 WHEN regexp_matches(line, '^\|?( ?:?-+:? ?\|)+ ?(:?-+:? ?)?$') THEN 'table_rule'
 WHEN contains(line, '|') THEN CASE WHEN NOT regexp_matches(line, '^\|.*\|$') THEN 'table_malformed'
   WHEN length(regexp_replace(line, '[^0-9]', '', 'g')) > 0.5 * length(regexp_replace(line, '[^\p{L}\p{N}]', '', 'g')) THEN 'table_dense' ELSE 'table' END
 WHEN regexp_matches(line, '[=^\\].*[+/^\\]') THEN 'formula' WHEN trim(line) = '' THEN 'blank'
 WHEN length(regexp_replace(line, '[^0-9]', '', 'g')) > 0.5 * length(regexp_replace(line, '\s', '', 'g')) THEN 'figure_text'
 WHEN length(regexp_replace(line, '[^#$%&*@^~|<>{}\\]', '', 'g')) > 0.05 * length(line) THEN 'noise' ELSE 'prose' END"""
VIEWED = """vl AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents
), vh AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,2} ') THEN """ + CANON + """ END AS head FROM vl
), vs AS (
  SELECT doc_id, pos, line, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section,
         regexp_matches(line, '^#{1,6} ') AS heading, """ + KIND + """ AS kind FROM vh
), viewed AS (
  SELECT doc_id, coalesce(string_agg(CASE WHEN kind = 'formula' AND NOT heading THEN '> [... omitted from AI extraction: formula]' ELSE line END, chr(10) ORDER BY pos)
    FILTER (NOT regexp_matches(section, '^(references|bibliography|contents|table of contents|(neurips )?paper checklist|checklist)$')
            AND (heading OR kind NOT IN ('table_malformed', 'table_dense', 'figure_text', 'noise'))), '') AS text
  FROM vs GROUP BY doc_id
)"""


@query("WITH " + VIEWED + " SELECT doc_id, CAST(length(text) AS BIGINT) AS view_chars, sha256(text) AS view_sha256, 6 AS view_version FROM viewed")
def processing_view(spark, d):
    """P1-P9, F13, W3 over every document"""
    v = L.processing_view(docs(spark, d).select("doc_id", "text"))
    return v.select("doc_id", F.length("content").cast("bigint").alias("view_chars"), X.sha256(F.col("content")).alias("view_sha256"), "view_version")


SCAN = "WITH RECURSIVE " + VIEWED + ", " + PIECES.lstrip().replace("FROM documents WHERE text IS NOT NULL", "FROM viewed") + f""", fold AS (
  SELECT doc_id, n, s AS start, s AS last, e, 1 AS no FROM pieces WHERE n = 1
  UNION ALL
  SELECT doc_id, n, CASE WHEN fits THEN start WHEN carry THEN last ELSE s END, s, e, CASE WHEN fits THEN no ELSE no + 1 END
  FROM (SELECT p.doc_id, p.n, p.s, p.e, f.start, f.last, f.no, p.e - f.start <= 4000 AS fits,
               p.s - f.last <= 201 AND f.e - f.last <= 200 AND p.e - f.last <= 4000 AND f.last > f.start AS carry
        FROM fold f JOIN pieces p ON p.doc_id = f.doc_id AND p.n = f.n + 1)
), chunked AS (SELECT doc_id, no, min(start) AS s, max(e) AS e FROM fold GROUP BY doc_id, no),
concepts AS (
  SELECT doc_id, no, trim(regexp_extract(substr(text, s + 1, e - s), '^([^.!?\n]{{1,80}})', 1)) AS title FROM chunked JOIN viewed USING (doc_id)
), named AS (SELECT *, {IDENT.format(x='title')} AS i FROM concepts WHERE title <> ''),
merged AS (SELECT doc_id, i, min(no) AS no, arg_min(title, no) AS title, count(*) AS excerpts FROM named WHERE i <> '' GROUP BY 1, 2),
cands AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no, i) AS cand, regexp_replace(i, '( (architecture|framework|system|mechanism|method|approach))+$', '') AS sig,
         i IN ({', '.join(repr(t) for t in C.GENERIC_TITLES)}) AS generic FROM merged
), grouped AS (SELECT *, min(cand) OVER (PARTITION BY doc_id, sig) AS hub, count(*) OVER (PARTITION BY doc_id, sig) AS members, count(*) OVER (PARTITION BY doc_id) AS total FROM cands),
picked AS (SELECT *, hub = cand AS selected FROM grouped),
sums AS (
  SELECT doc_id, count(*) AS candidates, count(*) FILTER (selected) AS selected, sum(excerpts) AS excerpts, max(CASE WHEN members > 1 OR total > 12 THEN 1 ELSE 0 END) AS curator_calls,
         count(*) FILTER (selected AND generic) AS g FROM picked GROUP BY 1
), sized AS (SELECT doc_id, count(*) AS chunks, round(avg(e - s), 1) AS avg_chunk, max(e - s) AS max_chunk FROM chunked GROUP BY 1),
reported AS (
  SELECT d.doc_id AS source_id, CAST(length(coalesce(d.text, '')) AS BIGINT) AS source_chars, CAST(length(v.text) AS BIGINT) AS processing_chars, coalesce(chunks, 0) AS chunks, coalesce(avg_chunk, 0.0) AS avg_chunk,
         CAST(coalesce(max_chunk, 0) AS BIGINT) AS max_chunk, coalesce(candidates, 0) AS candidates, coalesce(selected, 0) AS selected, coalesce(curator_calls, 0) AS curator_calls, CAST(coalesce(excerpts, 0) AS BIGINT) AS excerpts,
         concat_ws(',', CASE WHEN selected > 0 AND g = selected THEN 'only_generic' END, CASE WHEN selected > 12 THEN 'too_many' END) AS reasons
  FROM documents d JOIN viewed v USING (doc_id) LEFT JOIN sized USING (doc_id) LEFT JOIN sums USING (doc_id)
)"""


def _scan(spark, d):
    sources = docs(spark, d).select(F.col("doc_id").alias("source_id"), F.concat_ws(" ", F.lit("document"), F.col("doc_id").cast("string")).alias("title"), "text")
    return R.scan(sources)


@query(SCAN + """ SELECT source_id, source_chars, processing_chars, chunks, avg_chunk, max_chunk, candidates, selected, CAST(curator_calls AS INTEGER) AS curator_calls, excerpts AS located, excerpts,
 CAST(chunks + curator_calls AS BIGINT) AS llm_calls, CASE WHEN reasons = '' THEN 'pass' ELSE 'failed' END AS gate, reasons, CASE WHEN reasons = '' THEN 0 ELSE 6 END AS exit_code,
 'located ' || excerpts || '/' || excerpts || ' across ' || candidates || ' candidates' AS locatability FROM reported""")
def scan_report(spark, d):
    """The main path over every document with the fake provider: view, chunks, replies, merge, roles, coverage, curator, gate"""
    return _scan(spark, d).report.select(
        "source_id", "source_chars", "processing_chars", "chunks", "avg_chunk", "max_chunk", "candidates", "selected", "curator_calls", "located", "excerpts", "llm_calls", "gate", "reasons",
        "exit_code", "locatability")


@query(SCAN + f""", kept AS (SELECT p.* FROM picked p JOIN reported r ON r.source_id = p.doc_id WHERE p.selected AND reasons = '')
 SELECT min(doc_id) AS source_id, arg_min(title, doc_id) AS title, '{C.WIKI_DIR}/' || replace(i, ' ', '-') || '.md' AS path, 'create' AS action, count(DISTINCT doc_id) AS sources FROM kept GROUP BY i""")
def scan_plan(spark, d):
    """The main path's last step: one planned note for each identity of the sources that passed"""
    p = _scan(spark, d).plan
    return p.select("source_id", "title", "path", "action", F.size("all_sources").cast("bigint").alias("sources"))


def _pairs(spark, d):
    """Texts and benchmark texts that may be located in them, both as they are and normalised."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"), X.normal_excerpt(F.col("text")).alias("needle")).where("needle <> ''")
    texts = docs(spark, d).select("doc_id", "text", X.normal_excerpt(F.col("text")).alias("hay"))
    pairs = candidate_pairs(texts.select("doc_id", "hay"), items.select("item_id", "needle"))
    return texts.join(pairs, "doc_id").join(items, "item_id")


def _located(spark, d):
    return _pairs(spark, d).where(F.contains("hay", F.col("needle")))


@query(f"""SELECT doc_id, item_id, CAST(instr(h, n) - 1 AS BIGINT) AS "start", CAST(instr(h, n) - 1 + length(n) AS BIGINT) AS "end"
 FROM (SELECT doc_id, {NORMAL.format(x='text')} AS h FROM documents), (SELECT item_id, {NORMAL.format(x='text')} AS n FROM benchmark)
 WHERE n <> '' AND instr(h, n) > 0""")
def locate_benchmark(spark, d):
    """F7 on normalised text, W6 without a preferred range"""
    at = F.expr("instr(hay, needle)").cast("bigint")
    return _located(spark, d).select("doc_id", "item_id", (at - 1).alias("start"), (at - 1 + F.length("needle")).alias("end"))


PLACES = f"""WITH hit AS MATERIALIZED (
  SELECT doc_id, item_id, text, h, n FROM (SELECT doc_id, text, {NORMAL.format(x='text')} AS h FROM documents), (SELECT item_id, {NORMAL.format(x='text')} AS n FROM benchmark) WHERE n <> '' AND instr(h, n) > 0
), chars AS MATERIALIZED (
  SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(0, length(text))) AS pos FROM (SELECT DISTINCT doc_id, text FROM hit)
), bare AS (SELECT * FROM chars WHERE c NOT IN ('*', '_', '`')),
blanks AS (SELECT *, regexp_matches(c, '^[ \\t\\n\\r\\f]$') AS blank FROM bare),
runs AS (SELECT *, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY pos), true) AS before FROM blanks),
kept AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM runs WHERE NOT (blank AND before)),
pieces AS (SELECT doc_id, item_id, length(n) AS size, unnest(list_transform(string_split(h, n), lambda x: length(x))) AS gap, unnest(range(1, len(string_split(h, n)) + 1)) AS i FROM hit),
places AS (
  SELECT * FROM (SELECT doc_id, item_id, size, CAST(1 + (i - 1) * size + sum(gap) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS BIGINT) AS p, i, max(i) OVER (PARTITION BY doc_id, item_id) AS m FROM pieces) WHERE i < m
),
begun AS MATERIALIZED (
  SELECT x.doc_id, x.item_id, a.pos AS s, x.p + x.size - 1 AS last FROM places x JOIN kept a ON a.doc_id = x.doc_id AND a.k = x.p
), found AS (
  SELECT x.doc_id, x.item_id, x.s, b.pos + 1 AS e FROM begun x JOIN kept b ON b.doc_id = x.doc_id AND b.k = x.last
)"""


@query(PLACES + ' SELECT doc_id, item_id, min(s) AS "start", arg_min(e, s) AS "end" FROM found GROUP BY 1, 2')
def locate_original(spark, d):
    """benchmark texts in documents, as places in the original text"""
    pairs = _located(spark, d).select("doc_id", "item_id", F.col("item").alias("excerpt"))
    return locate(pairs, docs(spark, d).select("doc_id", F.col("text").alias("content")), "doc_id").select("doc_id", "item_id", "start", "end")


@query(PLACES + """, r AS (SELECT doc_id, item_id, s, e, s >= length(text) // 2 AS inside FROM found JOIN documents USING (doc_id))
 SELECT doc_id, item_id, arg_min(s, (CASE WHEN inside THEN 0 ELSE 1000000000 END) + s) AS "start", arg_min(e, (CASE WHEN inside THEN 0 ELSE 1000000000 END) + s) AS "end" FROM r GROUP BY 1, 2""")
def locate_preferred(spark, d):
    """The same, a hit in the second half of the text before others"""
    size = F.length("text")
    pairs = _located(spark, d).select(
        "doc_id", "item_id", F.col("item").alias("excerpt"), F.floor(size / 2).alias("pref_start"), size.alias("pref_end"))
    return locate(pairs, docs(spark, d).select("doc_id", F.col("text").alias("content")), "doc_id").select("doc_id", "item_id", "start", "end")


@query(f"""SELECT count(DISTINCT item_id) FILTER (hit) AS located, count(DISTINCT item_id) AS total,
 'located ' || count(DISTINCT item_id) FILTER (hit) || '/' || count(DISTINCT item_id) AS line
 FROM (SELECT item_id, EXISTS (SELECT 1 FROM documents WHERE instr({NORMAL.format(x='documents.text')}, {NORMAL.format(x='b.text')}) > 0) AS hit FROM benchmark b)""")
def evidence_locatability(spark, d):
    """A6, A11, F19"""
    hits = _located(spark, d).select("item_id").distinct().withColumn("hit", F.lit(1))
    a = table(spark, d, "benchmark").join(hits, "item_id", "left").agg(
        F.count("hit").alias("located"), F.count(F.lit(1)).alias("total"))
    return a.select("*", F.format_string("located %d/%d", "located", "total").alias("line"))


@query(FOLD + f""", evidence AS (
 SELECT doc_id, item_id, instr(h, n) - 1 AS s, instr(h, n) - 1 + length(n) AS e
 FROM (SELECT doc_id, text AS h FROM documents), (SELECT item_id, text AS n FROM benchmark) WHERE n <> '' AND instr(h, n) > 0)
 SELECT doc_id, item_id, string_agg(CAST(chunk_no AS VARCHAR), ',' ORDER BY chunk_no) AS offset_chunks
 FROM evidence JOIN chunked USING (doc_id) WHERE "start" < e AND s < "end" GROUP BY doc_id, item_id""")
def chunk_of_evidence(spark, d):
    """Chunks that overlap a located span"""
    spans = _pairs(spark, d).where(F.contains("text", F.col("item"))).select(
        "doc_id", "item_id", F.expr("instr(text, item) - 1").alias("s"), F.expr("instr(text, item) - 1 + length(item)").alias("e"))
    c = K.chunks(docs(spark, d), "doc_id").select("doc_id", "chunk_no", "start", "end")
    return (
        spans.join(c, "doc_id").where("start < e and s < end").groupBy("doc_id", "item_id")
        .agg(F.array_sort(F.collect_list("chunk_no")).alias("c"))
        .select("doc_id", "item_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("offset_chunks")))


@query(f"""SELECT min(doc_id) AS doc_id, count(*) AS members, min(source) AS first_source, count(DISTINCT source) AS sources
 FROM documents GROUP BY sha256({IDENT.format(x='text')})""")
def identity_dedup(spark, d):
    """A1: the smallest key of an identity wins, evidence (here sources) is united"""
    return docs(spark, d).groupBy(X.sha256(X.identity(F.col("text"))).alias("i")).agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("members"), F.min("source").alias("first_source"),
        F.countDistinct("source").alias("sources")).drop("i")


@query(f"""WITH h AS (SELECT doc_id, sha256({IDENT.format(x='text')}) AS i FROM documents)
 SELECT doc_id, min(doc_id) OVER (PARTITION BY i) AS class_id, count(*) OVER (PARTITION BY i) - 1 AS links FROM h""")
def dup_risk_documents(spark, d):
    """J10, A2 over documents: classes of equal identities (classes and counts, no pairs)"""
    h = docs(spark, d).select("doc_id", X.sha256(X.identity(F.col("text"))).alias("i"))
    c = h.groupBy("i").agg(F.min("doc_id").alias("class_id"), (F.count(F.lit(1)) - 1).alias("links"))
    return h.join(c, "i").select("doc_id", "class_id", "links")


SYMBOLS = "[#$%&*@^~|<>{}\\\\]"


@query(rf"""WITH {LINES} SELECT doc_id, ord, length(regexp_replace(line, '[^#$%&*@^~|<>{{}}\\]', '', 'g')) AS symbols,
 length(regexp_replace(line, '[^#$%&*@^~|<>{{}}\\]', '', 'g')) > 0.05 * length(line) AS noise FROM blocks""")
def noise_lines(spark, d):
    """P5, P9"""
    n = F.regexp_count("text", F.lit(SYMBOLS))
    return K.blocks(docs(spark, d), "doc_id").select(
        "doc_id", "ord", n.cast("bigint").alias("symbols"), (n > F.lit(C.NOISE_SYMBOL_SHARE) * F.length("text")).alias("noise"))


@query(rf"""WITH {LINES} SELECT doc_id, ord, length(line) - length(replace(line, '|', '')) AS pipes,
 length(regexp_replace(line, '[^0-9]', '', 'g')) > 0.5 * length(regexp_replace(line, '[^\p{{L}}\p{{N}}]', '', 'g')) AS dense
 FROM blocks WHERE contains(line, '|')""")
def table_lines(spark, d):
    """P7 on the tables' pipe lines"""
    b = K.blocks(docs(spark, d), "doc_id").where(F.contains("text", F.lit("|")))
    digits, letters = F.regexp_count("text", F.lit("[0-9]")), F.regexp_count("text", F.lit(r"[\p{L}\p{N}]"))
    return b.select("doc_id", "ord", F.regexp_count("text", F.lit(r"\|")).cast("bigint").alias("pipes"),
                    (digits > F.lit(C.TABLE_DIGIT_SHARE) * letters).alias("dense"))


@query("""SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 200 THEN 3 ELSE 0 END AS exit_code FROM documents""")
def low_text(spark, d):
    """S3"""
    return docs(spark, d).select("doc_id", F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) < C.LOW_TEXT_CHARS, C.EXITS["ocr"]).otherwise(0).alias("exit_code"))


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS (SELECT doc_id, regexp_matches(text, '(?m)^[a-z]') AS a, regexp_matches(text, '\|') AS b, regexp_matches(text, '[#$%&]{3}') AS c,
 regexp_matches(text, '[\p{L}]{30}') AS d, regexp_matches(text, '(?m)^[^\n]$') AS e FROM t)
 SELECT doc_id, concat_ws(',', CASE WHEN a THEN 'reading_order' END, CASE WHEN b THEN 'table_layout' END, CASE WHEN c THEN 'formula_layout' END,
 CASE WHEN d THEN 'word_joining' END, CASE WHEN e THEN 'rotated_text' END) AS extraction_warnings,
 CASE WHEN a OR b OR c OR d OR e THEN 'review' ELSE 'good' END AS extraction_quality FROM f""")
def quality_codes(spark, d):
    """S4; the detectors are ours: lines that start in lower case, pipes, symbol runs, very long words, lines of one character"""
    t = F.coalesce("text", F.lit(""))
    tests = (r"(?m)^[a-z]", r"\|", r"[#$%&]{3}", r"[\p{L}]{30}", r"(?m)^[^\n]$")
    codes = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in zip(C.WARNINGS, tests)]))
    x = docs(spark, d).select("doc_id", F.array_distinct(codes).alias("c"))
    return x.select("doc_id", F.array_join("c", ",").alias("extraction_warnings"), F.when(F.size("c") > 0, "review").otherwise("good").alias("extraction_quality"))


def _sql_unescape(x: str) -> str:
    for a, b in P.ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def _sql_markdown(x: str) -> str:
    for pattern, into in P.STEPS:
        esc = into.replace("\n", "' || chr(10) || '")
        x = f"regexp_replace({x}, '{pattern}', '{esc}', 'g')"
    return rf"regexp_replace({_sql_unescape(x)}, '^\s+|\s+$', '', 'g')"


def _said(pattern: str) -> str:
    found = "regexp_extract(html, '" + pattern.replace("'", "''") + "', 1)"
    return f"nullif(trim({_sql_unescape(found)}), '')"


SQL_TITLE = _sql_unescape(f"trim(regexp_extract(html, '{P.TITLE}', 1))")


@query(f"SELECT page_id, {SQL_TITLE} AS title, {_sql_unescape(f'''trim(regexp_extract(html, '{P.H1}', 1))''')} AS h1 FROM pages")
def page_titles(spark, d):
    """Title and first heading"""
    return table(spark, d, "pages").select(
        "page_id", P.title(F.col("html")).alias("title"), P.unescape(F.trim(F.regexp_extract("html", P.H1, 1))).alias("h1"))


@query(f"SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{P.HREF}', 1)) AS href FROM pages) GROUP BY ALL")
def page_links(spark, d):
    """Links as edges"""
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(P.HREF), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, {_sql_markdown('html')} AS markdown FROM pages")
def page_text(spark, d):
    """Markdown of a page"""
    return table(spark, d, "pages").select("page_id", P.to_markdown(F.col("html")).alias("markdown"))


@query(f"""SELECT page_id, 'source' AS "type", 'external' AS origin, 'raw' AS knowledge_status, '' AS domain, DATE '2026-01-01' AS created,
 DATE '2026-01-01' AS updated, 'web' AS source_type, coalesce({_said(P.CANONICAL)}, nullif(trim(url), '')) AS source_url, nullif({SQL_TITLE}, '') AS title,
 {_said(P.AUTHOR)} AS author, TRY_CAST({_said(P.PUBLISHED)} AS DATE) AS published, false AS human_verified FROM pages""")
def web_properties(spark, d):
    """S8"""
    return P.properties(table(spark, d, "pages"), "2026-01-01")


@query(f"""SELECT page_id, sha256('# ' || t || chr(10) || chr(10) || '## Source' || chr(10) || chr(10) || url || chr(10) || chr(10) || '## Content' || chr(10) || chr(10) || m
 || chr(10) || chr(10) || '## My Highlights' || chr(10) || chr(10) || '## Related' || chr(10)) AS note_sha256, t <> '' AS has_title, regexp_matches(url, '^https?://[^/ ]+') AS has_url, m <> '' AS has_content
 FROM (SELECT page_id, url, {SQL_TITLE} AS t, {_sql_markdown('html')} AS m FROM pages)""")
def web_note(spark, d):
    """S9"""
    x = table(spark, d, "pages").select("page_id", "url", P.title(F.col("html")).alias("t"), P.to_markdown(F.col("html")).alias("m"))
    return x.select("page_id", X.sha256(P.note_body(F.col("t"), F.col("url"), F.col("m"))).alias("note_sha256"), (F.col("t") != "").alias("has_title"),
                    F.col("url").rlike("^https?://[^/ ]+").alias("has_url"), (F.col("m") != "").alias("has_content"))


@query("""SELECT doc_id, sha256(text) AS content_hash FROM documents d WHERE NOT EXISTS
 (SELECT 1 FROM labels l JOIN documents e ON e.doc_id = l.doc_id WHERE l.quality = 1 AND l.doc_id = d.doc_id AND sha256(e.text) = sha256(d.text))""")
def unchanged_skip(spark, d):
    """Labelled good stands for processed; only new or changed sources go on"""
    now = docs(spark, d).select("doc_id", X.sha256(F.col("text")).alias("content_hash"))
    state = table(spark, d, "labels").where("quality = 1").select("doc_id").join(now, "doc_id")
    return now.join(state, ["doc_id", "content_hash"], "left_anti")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def source_scope(spark, d):
    """S11"""
    return docs(spark, d).where(F.col("source") == "src3").select("doc_id", "lang", "n_chars")


@query(FOLD + f"""
 SELECT doc_id, chunk_no, title, {IDENT.format(x='title')} AS identity, excerpt FROM (
 SELECT doc_id, chunk_no, trim(regexp_extract(t, '^([^.!?\\n]{{1,80}})', 1)) AS title, substr(t, 1, 300) AS excerpt FROM (
 SELECT c.doc_id, chunk_no, substr(text, "start" + 1, "end" - "start") AS t FROM chunked c JOIN documents USING (doc_id)))
 WHERE title <> ''""")
def fake_extract(spark, d):
    """The deterministic provider names a chunk's first sentence"""
    from scrivenry.operators.extract import fake_concepts

    return fake_concepts(K.chunks(docs(spark, d), "doc_id"), "doc_id")


@query("""SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""")
def conversation_notes(spark, d):
    """W1 style ordering over multi-turn notes"""
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), F.sum(F.length("text")).cast("bigint").alias("chars")
    ).select("conv_id", "turns", F.array_join("r.role", ">").alias("roles"), "chars")


@query(r"""SELECT doc_id, replace(replace(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '?', 'g'), chr(13), '\r'), chr(10), '\n') AS line FROM documents""")
def report_escape(spark, d):
    """Every document as one report line: what the console cannot show and line ends are escaped; a null text is an empty line"""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?")
    return docs(spark, d).select("doc_id", F.replace(F.replace(plain, F.lit("\r"), F.lit(r"\r")), F.lit("\n"), F.lit(r"\n")).alias("line"))
