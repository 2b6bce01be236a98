"""Section operators over every document, each set in a paper around its text; the SQL is that of the fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scrivenry.operators import coverage as V, headings as H
from scrivenry.plans.fixture_queries import PARSED, SPANS, SUBS
from scrivenry.sources.tables import table

QUERIES = {}
ORACLES = {}

#: What stands around a text, in order; {t} is the text, {h} its first two words.
PARTS = (
    "# Paper {d}\n\n### Page 1\n\nIntro.\n\n## 3 Proposed Methodolodgy\n\n### 3.1 {h}\n\n", "{t}", "\n\n### Page 2\n\n#### 3.1.1 Inner part\n\nInner {d}.\n\n### 3.2 Link Finding\n\n"
    "### 3.3 Experiment Setup\n\nSetup.\n\n## References\n\nNobody.\n\n## Appendix\n\nMore {d}.",
)
HEAD = "([A-Za-z]+) +([A-Za-z]+)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _sql_part(x: str) -> str:
    quoted = "'" + x.replace("\n", "' || chr(10) || '") + "'"
    for name, column in (("{d}", "doc_id"), ("{h}", f"coalesce(nullif(regexp_extract(text, '{HEAD}', 0), ''), 'Some part')"), ("{t}", "text")):
        quoted = quoted.replace(name, f"' || {column} || '")
    return quoted


LINES = "WITH papers AS (SELECT doc_id AS source_id, " + " || ".join(map(_sql_part, PARTS)) + """ AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), lines AS (SELECT source_id, unnest(range(0, len(string_split(t, chr(10))))) AS ord, unnest(string_split(t, chr(10))) AS line FROM papers)"""


def papers(spark, d) -> DataFrame:
    """(source_id, content) of every document in a paper."""
    text = F.coalesce("text", F.lit(""))
    values = {"{d}": F.col("doc_id").cast("string"), "{t}": text, "{h}": F.coalesce(F.nullif(F.regexp_extract(text, HEAD, 0), F.lit("")), F.lit("Some part"))}

    def filled(x: str) -> Column:
        out = F.lit(x)
        for name in ("{d}", "{h}", "{t}"):
            if name in x:
                out = F.replace(out, F.lit(name), values[name])
        return out

    return table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.concat(*[filled(x) for x in PARTS]).alias("content"))


def _outlines(spark, d) -> DataFrame:
    return H.outlines(papers(spark, d))


@query(LINES + PARSED + " SELECT source_id, ord, start, page, level::BIGINT AS level, number, depth::BIGINT AS depth, canonical FROM q WHERE level > 0 OR page IS NOT NULL")
def paper_headings(spark, d):
    """F10, F12, W4 over every document"""
    return _outlines(spark, d).select("source_id", F.inline("marks")).select("source_id", "ord", "start", "page", "level", "number", "depth", "canonical")


@query(LINES + SPANS + ' SELECT source_id, ord, canonical, start, e AS "end" FROM sp')
def paper_spans(spark, d):
    """G5 over every document"""
    return _outlines(spark, d).select("source_id", F.inline("marks")).where("level > 0").select("source_id", "ord", "canonical", "start", "end")


@query(LINES + SUBS + """ SELECT s.source_id, sub_id, canonical, heading, s.start, e AS "end", (SELECT array_to_string(list_sort(list_distinct(list(page))), ',') FROM (
 SELECT page FROM q WHERE q.source_id = s.source_id AND page IS NOT NULL AND q.start >= s.start AND q.start < s.e UNION ALL
 (SELECT page FROM q WHERE q.source_id = s.source_id AND page IS NOT NULL AND q.start < s.start ORDER BY q.start DESC LIMIT 1))) AS pages FROM sub s""")
def paper_subsections(spark, d):
    """F8, F11, P10-P12, W1, W2, A8, U4 over every document"""
    x = _outlines(spark, d).select("source_id", F.inline(H.subsections(F.col("marks")))).drop("width", "filled")
    return x.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query(LINES + PARSED + r""", w AS (SELECT *, coalesce(last_value(CASE WHEN level > 0 AND level <= 2 THEN canonical END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM q)
 SELECT source_id, count(*) AS lines, string_agg(DISTINCT section, '|' ORDER BY section) AS sections FROM w
 WHERE NOT regexp_matches(section, '^(references|bibliography|contents|table of contents|(neurips )?paper checklist|checklist)$') GROUP BY 1""")
def paper_sections(spark, d):
    """P1-P4, W3 over every document"""
    x = _outlines(spark, d).select("source_id", H.kept_sections(F.col("marks"), F.col("lines")).alias("kept")).where(F.size("kept") > 0)
    return x.select("source_id", F.aggregate("kept", F.lit(0).cast("bigint"), lambda n, k: n + k["lines"]).alias("lines"),
                    F.array_join(F.array_sort(F.array_distinct(F.col("kept")["section"])), "|").alias("sections"))


@query(LINES + SUBS + r""", bodies AS (SELECT s.*, regexp_replace(substr(t, s.start::INT + 1, (s.e - s.start)::INT), '^[^\n]*\n?', '') AS body FROM sub s JOIN papers USING (source_id)),
 t AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start) AS n FROM bodies WHERE regexp_matches(body, '\S'))
 SELECT source_id, n, sub_id, 'subsection-' || substr(sub_id, 4) || '-' || substr(sha256(heading || chr(10) || substr(body, 1, 4000)), 1, 16) AS target_id FROM t WHERE n <= 8""")
def paper_targets(spark, d):
    """G7, P14, W7, L4, F9 over every document, where nothing is covered"""
    open_ = F.filter(H.subsections(F.col("marks")), lambda x: x["filled"])
    t = _outlines(spark, d).select("source_id", F.posexplode(V.first_bodies(open_, F.col("content"))).alias("p", "t"))
    return t.select("source_id", (F.col("p") + 1).cast("bigint").alias("n"), F.col("t.sub_id").alias("sub_id"), V.target_id(F.col("t.sub_id"), F.col("t.heading"), F.col("t.body")).alias("target_id"))
