"""Queries over literal fixtures, for operators that the driver's tables have no rows for."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivenry import config as C
from scrivenry.functions import text as X
from scrivenry.operators import candidates as A, coverage as V, extract as E, headings as H, notes as N, view as L
from scrivenry.plans.fixtures import frame, with_values

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def ident(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '^(a|an|the) ', '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '( (architecture|framework|system|mechanism|method|approach))+$', '')"


def canon(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


ALIASED = f""", al AS (
  SELECT *, list_distinct(list_filter([{ident('source_title')}, {ident("trim(split_part(source_title, ':', 1))")},
    CASE WHEN contains(source_title, ':') THEN regexp_extract({ident("trim(substr(source_title, strpos(source_title, ':') + 1))")}, '^(.*?)( (?:for|in|with|of|via) .*)?$', 1) END],
    lambda x: x IS NOT NULL AND x <> '')) AS names, {ident('title')} AS whole FROM titles)"""


@query(with_values("titles") + ALIASED + f""" SELECT source_title, title, array_to_string(list_sort(list_distinct(list_filter(list_transform(
 list_concat([whole], list_transform(list_filter(names, lambda a: starts_with(whole, a || ' ')), lambda a: substr(whole, length(a) + 2))),
 lambda x: {strip('x')}), lambda x: x <> ''))), '|') AS signatures FROM al""")
def signatures(spark, d):
    """F3, F4, F5"""
    t = frame(spark, "titles").withColumn("names", X.aliases(F.col("source_title")))
    return t.select("source_title", "title", F.array_join(X.signatures(F.col("title"), F.col("names")), "|").alias("signatures"))


@query(with_values("titles") + ALIASED + " SELECT source_title, title, array_to_string(list_sort(names), '|') AS aliases, list_contains(names, whole) AS primary_entity FROM al")
def primary_entity(spark, d):
    """F4, F16"""
    t = frame(spark, "titles").withColumn("names", X.aliases(F.col("source_title")))
    return t.select("source_title", "title", F.array_join(F.array_sort("names"), "|").alias("aliases"),
                    F.array_contains("names", X.identity(F.col("title"))).alias("primary_entity"))


PARSED = f""", p0 AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY source_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    TRY_CAST(nullif(regexp_extract(line, '^### Page ([0-9]+)$', 1), '') AS BIGINT) AS page, length(regexp_extract(line, '^(#{{1,6}}) ', 1)) AS lv,
    regexp_replace(trim(regexp_replace(line, '^#{{1,6}} +', '')), '[*_`]', '', 'g') AS rest FROM lines
), p AS (
  SELECT *, CASE WHEN page IS NULL THEN lv ELSE 0 END AS level, regexp_extract(rest, '^([0-9]+(?:\\.[0-9]+)*)\\.? ', 1) AS number,
    trim(regexp_replace(rest, '^[0-9]+(\\.[0-9]+)*\\.? ', '')) AS heading, {canon("trim(regexp_replace(rest, '^[0-9]+(\\.[0-9]+)*\\.? ', ''))")} AS canonical FROM p0
), q AS (SELECT *, CASE WHEN number = '' THEN 0 ELSE length(number) - length(replace(number, '.', '')) + 1 END AS depth FROM p)"""
SPANS = PARSED + """, tot AS (SELECT source_id, max(start + length(line)) AS total FROM q GROUP BY 1), sp AS (
  SELECT h.source_id, h.ord, h.start, h.level, h.number, h.depth, h.canonical, h.heading, coalesce((SELECT min(l.start) FROM q l WHERE l.source_id = h.source_id AND l.level > 0 AND l.start > h.start
    AND CASE WHEN h.number <> '' AND l.number <> '' THEN l.depth <= h.depth ELSE l.level <= h.level END), total) AS e
  FROM q h JOIN tot USING (source_id) WHERE h.level > 0)"""


def sql_close(w: str) -> str:
    return "(" + " OR ".join(f"{w} = '{n}'" if len(n) < 6 else f"levenshtein({w}, '{n}') <= 2" for n in C.ROOT_WORDS) + ")"


ROOT = (f"(length(canonical) > 0 AND {sql_close('string_split(canonical, chr(32))[-1]')} AND len(string_split(canonical, ' ')) <= 3 "
        f"AND NOT regexp_matches(canonical, '(^| )({'|'.join(C.ROOT_EXCLUDED)})'))")
EXCLUDED = f"regexp_matches(canonical, '(^| )({'|'.join(C.SUBSECTION_EXCLUDED)})')"
SUBS = SPANS + f""", ins AS (SELECT s.* FROM sp s WHERE EXISTS (SELECT 1 FROM sp r WHERE {ROOT.replace('canonical', 'r.canonical')} AND r.source_id = s.source_id AND s.start > r.start AND s.start < r.e)
 AND NOT {EXCLUDED.replace('canonical', 's.canonical')}), sub AS (SELECT *, 'ms-' || substr(sha256(canonical || chr(10) || row_number() OVER (PARTITION BY source_id, canonical ORDER BY start)), 1, 8) AS sub_id FROM ins)"""


@query(with_values("lines") + PARSED + """ SELECT source_id, ord, start, page, level::BIGINT AS level, number, depth::BIGINT AS depth, canonical FROM q""")
def headings(spark, d):
    """F10, F12, W4"""
    return H.parse(frame(spark, "lines")).select("source_id", "ord", "start", "page", "level", "number", "depth", "canonical")


@query(with_values("lines") + SPANS + ' SELECT source_id, ord, canonical, start, e AS "end" FROM sp')
def subsection_spans(spark, d):
    """G5"""
    return H.spans(H.parse(frame(spark, "lines"))).select("source_id", "ord", "canonical", "start", "end")


@query(with_values("lines") + SPANS + f" SELECT source_id, ord, canonical, {ROOT} AS method_root, {EXCLUDED} AS excluded FROM sp")
def method_roots(spark, d):
    """F11, P10, P11, P12"""
    x = H.spans(H.parse(frame(spark, "lines")))
    return x.select("source_id", "ord", "canonical", X.is_method_root(F.col("canonical")).alias("method_root"), X.is_excluded_subsection(F.col("canonical")).alias("excluded"))


@query(with_values("lines") + SUBS + """ SELECT s.source_id, sub_id, canonical, heading, s.start, e AS "end", (SELECT array_to_string(list_sort(list_distinct(list(page))), ',') FROM (
 SELECT page FROM q WHERE q.source_id = s.source_id AND page IS NOT NULL AND q.start >= s.start AND q.start < s.e UNION ALL
 (SELECT page FROM q WHERE q.source_id = s.source_id AND page IS NOT NULL AND q.start < s.start ORDER BY q.start DESC LIMIT 1))) AS pages FROM sub s""")
def subsection_ids(spark, d):
    """F8, W1, W2, A8"""
    x = H.method_subsections(H.parse(frame(spark, "lines")))
    return x.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query(with_values("lines") + SUBS + " SELECT source_id, string_agg(canonical, '|' ORDER BY first) AS methodology_subsections FROM (SELECT source_id, canonical, min(start) AS first FROM sub GROUP BY 1, 2) GROUP BY 1")
def methodology_subsections(spark, d):
    """U4"""
    x = H.method_subsections(H.parse(frame(spark, "lines"))).groupBy("source_id", "canonical").agg(F.min("start").alias("first"))
    return x.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("first", "canonical")))["canonical"], "|").alias("methodology_subsections"))


@query(with_values("lines") + PARSED + r""", w AS (SELECT *, coalesce(last_value(CASE WHEN level > 0 AND level <= 2 THEN canonical END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM q)
 SELECT source_id, ord, section, line FROM w WHERE NOT regexp_matches(section, '^(references|bibliography|contents|table of contents|(neurips )?paper checklist|checklist)$')""")
def section_filter(spark, d):
    """P1, P2, P3, P4, W3"""
    return H.kept_lines(H.parse(frame(spark, "lines"))).select("source_id", "ord", "section", "line")


MARK = C.OMISSION


@query(with_values("view_lines") + rf""" SELECT id, CASE WHEN starts_with(line, '{MARK}') THEN 'omission' WHEN regexp_matches(line, '(?i)^(figure|fig\.) ?[0-9]') THEN 'caption'
 WHEN regexp_matches(line, '^\|?( ?:?-+:? ?\|)+ ?(:?-+:? ?)?$') THEN 'table_rule'
 WHEN contains(line, '|') THEN CASE WHEN NOT regexp_matches(line, '^\|.*\|$') THEN 'table_malformed'
   WHEN length(regexp_replace(line, '[^0-9]', '', 'g')) > 0.5 * length(regexp_replace(line, '[^\p{{L}}\p{{N}}]', '', 'g')) THEN 'table_dense' ELSE 'table' END
 WHEN regexp_matches(line, '[=^\\].*[+/^\\]') THEN 'formula' WHEN trim(line) = '' THEN 'blank'
 WHEN length(regexp_replace(line, '[^0-9]', '', 'g')) > 0.5 * length(regexp_replace(line, '\s', '', 'g')) THEN 'figure_text' ELSE 'prose' END AS kind,
 CASE WHEN regexp_matches(line, '[=^\\].*[+/^\\]') AND NOT contains(line, '|') THEN '{MARK}: formula]' ELSE line END AS shown FROM view_lines""")
def view_lines(spark, d):
    """P5, P6, P7, P8, P9, F13; the detectors are ours"""
    t = F.col("line")
    return frame(spark, "view_lines").select("id", L.line_kind(t).alias("kind"), L.shown_line(t).alias("shown"))


@query(with_values("candidates") + " SELECT source_id, cand_id, role FROM candidates WHERE role NOT IN ('baseline', 'analysis') AND (role NOT IN ('dataset', 'metric') OR own)")
def role_filter(spark, d):
    """P13"""
    return A.keep_roles(frame(spark, "candidates")).select("source_id", "cand_id", "role")


@query(with_values("candidates") + f""" SELECT source_id, cand_id, "primary" OR {ident('title')} IN ({', '.join(repr(t) for t in C.GENERIC_TITLES)}) AS generic FROM candidates""")
def generic_concepts(spark, d):
    """P17"""
    return frame(spark, "candidates").select("source_id", "cand_id", A.is_generic(F.col("title"), F.col("primary")).alias("generic"))


HEADCHUNKS = f""", hl AS (SELECT source_id, chunk_no, unnest(string_split(text, chr(10))) AS line FROM chunks), hc AS (
 SELECT DISTINCT source_id, chunk_no, {canon("trim(regexp_replace(regexp_replace(trim(regexp_replace(line, '^#{1,6} +', '')), '[*_`]', '', 'g'), '^[0-9]+(\\.[0-9]+)*\\.? ', ''))")} AS heading FROM hl WHERE regexp_matches(line, '^#{{1,6}} '))"""


@query(with_values("chunks", "candidates") + HEADCHUNKS + f""", located AS (SELECT *, 1 + (cand_id % 3) AS chunk_no FROM candidates)
 SELECT c.source_id, cand_id, title, CASE WHEN role = 'method_entity' AND EXISTS (SELECT 1 FROM hc WHERE hc.source_id = c.source_id AND hc.chunk_no = c.chunk_no
 AND {strip(ident('hc.heading'))} = {strip(ident('c.title'))}) THEN 'mechanism' ELSE role END AS role FROM located c""")
def role_promotion(spark, d):
    """F15"""
    c = frame(spark, "candidates").withColumn("chunk_no", 1 + F.pmod("cand_id", F.lit(3)))
    lines = frame(spark, "chunks").select("source_id", "chunk_no", F.explode(F.split("text", "\n")).alias("line")).where("line rlike '^#{1,6} '")
    return A.promote(c, lines.withColumn("heading", X.heading_parts(F.col("line"))["canonical"])).select("source_id", "cand_id", "title", "role")


SIGKEYS = f""", keyed AS (SELECT DISTINCT source_id, cand_id, {strip(ident('title'))} AS key FROM candidates WHERE {strip(ident('title'))} <> ''
 UNION SELECT source_id, cand_id, {strip("substr(" + ident('title') + ", 7)")} FROM candidates WHERE starts_with({ident('title')}, 'q net ') AND {strip("substr(" + ident('title') + ", 7)")} <> '')"""
GROUPS = SIGKEYS + """, reach AS (SELECT DISTINCT source_id, cand_id AS a, cand_id AS b FROM keyed UNION
 SELECT r.source_id, r.a, y.cand_id FROM reach r JOIN keyed x ON x.source_id = r.source_id AND x.cand_id = r.b JOIN keyed y ON y.source_id = x.source_id AND y.key = x.key),
 grp AS (SELECT source_id, a AS cand_id, min(b) AS "group" FROM reach GROUP BY 1, 2 HAVING count(*) > 1)"""


def _names():
    return F.array(F.lit("q net"))


@query(with_values("candidates", recursive=True) + GROUPS + ' SELECT source_id, cand_id, "group" FROM grp')
def dup_risk_groups(spark, d):
    """J10, A2"""
    return A.duplicate_groups(frame(spark, "candidates"), _names())


@query(with_values("candidates") + f""" SELECT source_id, {ident('title')} AS identity, arg_min(title, cand_id) AS title, count(*) AS merged, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM candidates GROUP BY 1, 2""")
def candidate_merge(spark, d):
    """General and targeted candidates united, then one for each identity; the first title wins (ours)"""
    c = frame(spark, "candidates")
    both = c.where("cand_id <= 3").unionByName(c.where("cand_id > 3"))
    return both.groupBy("source_id", X.identity(F.col("title")).alias("identity")).agg(
        F.min_by("title", "cand_id").alias("title"), F.count(F.lit(1)).alias("merged"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query(with_values("candidates", recursive=True) + GROUPS + f""", s AS (SELECT c.*, "group" FROM candidates c LEFT JOIN grp USING (source_id, cand_id)), a AS (SELECT source_id, count(*) FILTER (selected) AS n,
 count(*) FILTER (selected AND "primary") AS p, count(*) FILTER (selected AND "group" IS NOT NULL) - count(DISTINCT "group") FILTER (selected) AS dup, count(*) FILTER (role = 'mechanism') AS m_all,
 count(*) FILTER (selected AND role = 'mechanism') AS m, count(*) FILTER (selected AND ("primary" OR {ident('title')} IN ({', '.join(repr(t) for t in C.GENERIC_TITLES)}))) AS g FROM s GROUP BY 1),
 r AS (SELECT source_id, concat_ws(',', CASE WHEN n > 0 AND p > 0.5 * n THEN 'entity_dominance' END, CASE WHEN p > 1 THEN 'several_primary_entities' END, CASE WHEN dup > 0 THEN 'duplicate_risk' END,
 CASE WHEN m_all > 0 AND m = 0 THEN 'no_mechanism_selected' END, CASE WHEN n > 0 AND g = n THEN 'only_generic' END) AS reasons FROM a) SELECT source_id, CASE WHEN reasons = '' THEN 'pass' ELSE 'failed' END AS status, reasons FROM r""")
def quality_gate(spark, d):
    """A9"""
    c = frame(spark, "candidates")
    return A.gate(c, A.duplicate_groups(c, _names()))


@query(with_values("candidates", recursive=True) + GROUPS + """, a AS (SELECT source_id, count(*) AS n, count("group") AS g, avg("primary"::INT) AS p FROM candidates LEFT JOIN grp USING (source_id, cand_id) GROUP BY 1)
 SELECT source_id, n AS candidates, concat_ws(',', CASE WHEN n > 12 THEN 'too_many' END, CASE WHEN g > 0 THEN 'duplicate_risk' END, CASE WHEN p > 0.5 THEN 'entity_dominance' END) AS triggers FROM a""")
def curator_trigger(spark, d):
    """A10, L3, L5"""
    c = frame(spark, "candidates")
    s = c.join(A.duplicate_groups(c, _names()), ["source_id", "cand_id"], "left").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count("group").alias("g"), F.avg(F.col("primary").cast("int")).alias("p"))
    why = F.array_compact(F.array(F.when(F.col("candidates") > C.MAX_CONCEPTS, "too_many"), F.when(F.col("g") > 0, "duplicate_risk"), F.when(F.col("p") > C.DOMINANCE, "entity_dominance")))
    return s.select("source_id", "candidates", F.array_join(why, ",").alias("triggers"))


@query(with_values("candidates", "curator") + f""", k AS (SELECT source_id, cand_id, c.title, EXISTS (SELECT 1 FROM curator r WHERE r.source_id = c.source_id AND {ident('r.title')} = {ident('c.title')}) AS kept FROM candidates c),
 bad AS (SELECT source_id, count(*) AS unknown FROM curator r WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.source_id = r.source_id AND {ident('r.title')} = {ident('c.title')}) GROUP BY 1)
 SELECT source_id, count(*) FILTER (kept) AS kept, coalesce(any_value(unknown), 0) AS unknown, coalesce(any_value(unknown), 0) = 0 AS valid FROM k LEFT JOIN bad USING (source_id) GROUP BY 1""")
def curator_reply(spark, d):
    """J11, N6"""
    key = lambda df: df.withColumn("key", X.identity(F.col("title")))
    c, r = key(frame(spark, "candidates")), key(frame(spark, "curator")).select("source_id", "key").distinct()
    kept = c.join(r, ["source_id", "key"], "left_semi").groupBy("source_id").agg(F.count(F.lit(1)).alias("kept"))
    bad = r.join(c, ["source_id", "key"], "left_anti").groupBy("source_id").agg(F.count(F.lit(1)).alias("unknown"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return c.select("source_id").distinct().join(kept, "source_id", "left").join(bad, "source_id", "left").select(
        "source_id", zero("kept"), zero("unknown")).withColumn("valid", F.col("unknown") == 0)


COVER = f""", good AS (SELECT * FROM candidates WHERE role IN ('mechanism', 'component')), tcov AS (SELECT DISTINCT s.source_id, sub_id, cand_id FROM subsections s JOIN good g USING (source_id)
 WHERE {strip(ident('s.heading'))} = {strip(ident('g.title'))}), ecov AS (SELECT DISTINCT s.source_id, sub_id, g.cand_id FROM subsections s JOIN evidence e ON e.source_id = s.source_id AND e.located AND e.start >= s.start AND e."end" <= s."end"
 JOIN good g ON g.source_id = e.source_id AND g.cand_id = e.cand_id), open AS (SELECT s.* FROM subsections s WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM tcov UNION SELECT * FROM ecov) c WHERE c.source_id = s.source_id AND c.sub_id = s.sub_id))"""
BASE = ("candidates", "evidence", "subsections")


def _base(spark):
    return [frame(spark, n) for n in BASE]


@query(with_values(*BASE) + COVER + " SELECT source_id, sub_id, heading FROM open")
def uncovered_subsections(spark, d):
    """J3, J4, J5, U3"""
    c, e, s = _base(spark)
    return V.uncovered(s, c, e).select("source_id", "sub_id", "heading")


@query(with_values(*BASE) + COVER + """ SELECT s.source_id, s.sub_id, EXISTS (SELECT 1 FROM tcov t WHERE t.source_id = s.source_id AND t.sub_id = s.sub_id) AS title_candidates,
 EXISTS (SELECT 1 FROM ecov t WHERE t.source_id = s.source_id AND t.sub_id = s.sub_id) AS evidence_candidates,
 EXISTS (SELECT 1 FROM tcov t JOIN candidates c USING (source_id, cand_id) WHERE c.selected AND t.source_id = s.source_id AND t.sub_id = s.sub_id) AS title_selected,
 EXISTS (SELECT 1 FROM ecov t JOIN candidates c USING (source_id, cand_id) WHERE c.selected AND t.source_id = s.source_id AND t.sub_id = s.sub_id) AS evidence_selected FROM subsections s""")
def cover_flags(spark, d):
    """A7, J3, J4"""
    c, e, s = _base(spark)
    picked = c.select("source_id", "cand_id", "selected")

    def flags(cover, name):
        return cover.join(picked, ["source_id", "cand_id"]).groupBy("source_id", "sub_id").agg(F.lit(True).alias(f"{name}_candidates"), F.bool_or("selected").alias(f"{name}_selected"))

    out = s.join(flags(V.title_cover(s, c), "title"), ["source_id", "sub_id"], "left").join(flags(V.evidence_cover(s, c, e), "evidence"), ["source_id", "sub_id"], "left")
    return out.select("source_id", "sub_id", *[F.coalesce(f"{n}_{k}", F.lit(False)).alias(f"{n}_{k}") for n in ("title", "evidence") for k in ("candidates", "selected")])


@query(with_values(*BASE) + COVER + """, t AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start) AS n FROM open WHERE length(trim(body)) > 0)
 SELECT source_id, n::BIGINT AS n, sub_id, 'subsection-' || substr(sub_id, 4) || '-' || substr(sha256(heading || chr(10) || body), 1, 16) AS target_id FROM t WHERE n <= 8""")
def targeted_extraction(spark, d):
    """G7, P14, W7, L4, F9"""
    c, e, s = _base(spark)
    return V.targets(V.uncovered(s, c, e)).select("source_id", F.col("n").cast("bigint").alias("n"), "sub_id", "target_id")


@query(with_values(*BASE) + COVER + """, t AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start) AS n FROM open WHERE length(trim(body)) > 0), a AS (
 SELECT s.source_id, count(*) AS detected, count(*) FILTER (o.sub_id IS NULL) AS covered_before, count(*) FILTER (t.n <= 8) AS targeted, count(*) FILTER (t.n <= 8 AND t.n % 2 = 1) AS recovered
 FROM subsections s LEFT JOIN open o USING (source_id, sub_id) LEFT JOIN t USING (source_id, sub_id) GROUP BY 1)
 SELECT *, detected - covered_before - recovered AS still_uncovered, targeted AS calls, 'detected=' || detected || ' covered_before=' || covered_before || ' targeted=' || targeted || ' recovered=' || recovered ||
 ' still_uncovered=' || (detected - covered_before - recovered) || ' calls=' || targeted AS line FROM a""")
def recovery_counts(spark, d):
    """A5, F19; the fixture's provider answers every second call"""
    c, e, s = _base(spark)
    o = V.uncovered(s, c, e)
    t = V.targets(o).select("source_id", "sub_id", "n")
    a = s.join(o.select("source_id", "sub_id", F.lit(1).alias("o")), ["source_id", "sub_id"], "left").join(t, ["source_id", "sub_id"], "left").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("detected"), F.count_if(F.col("o").isNull()).alias("covered_before"), F.count("n").alias("targeted"), F.count_if(F.pmod("n", F.lit(2)) == 1).alias("recovered"))
    a = a.withColumn("still_uncovered", F.col("detected") - F.col("covered_before") - F.col("recovered")).withColumn("calls", F.col("targeted"))
    names = ("detected", "covered_before", "targeted", "recovered", "still_uncovered", "calls")
    return a.withColumn("line", F.format_string(" ".join(f"{n}=%d" for n in names), *names))


@query(with_values("subsections", "chunks") + HEADCHUNKS + """ SELECT s.source_id, s.sub_id, coalesce((SELECT string_agg(chunk_no::VARCHAR, ',' ORDER BY chunk_no) FROM hc WHERE hc.source_id = s.source_id AND hc.heading = s.heading), '') AS heading_chunks,
 coalesce((SELECT string_agg(chunk_no::VARCHAR, ',' ORDER BY chunk_no) FROM chunks c WHERE c.source_id = s.source_id AND c.start < s."end" AND s.start < c."end"), '') AS offset_chunks FROM subsections s""")
def subsection_chunks(spark, d):
    """J1, J2"""
    s, c = frame(spark, "subsections"), frame(spark, "chunks")
    joined = lambda df, n: df.groupBy("source_id", "sub_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("chunk_no")), lambda x: x.cast("string")), ",").alias(n))
    out = s.select("source_id", "sub_id").join(joined(V.heading_chunks(s, c), "heading_chunks"), ["source_id", "sub_id"], "left").join(joined(V.offset_chunks(s, c), "offset_chunks"), ["source_id", "sub_id"], "left")
    return out.fillna("", ["heading_chunks", "offset_chunks"])


@query(with_values(*BASE) + """ SELECT source_id, count(*) FILTER (located) AS located, count(*) AS excerpts, count(DISTINCT cand_id) AS candidates, 'located ' || count(*) FILTER (located) || '/' || count(*) || ' across ' || count(DISTINCT cand_id) || ' candidates' AS line FROM evidence GROUP BY 1""")
def locatability_lines(spark, d):
    """A6, F19, G8"""
    a = frame(spark, "evidence").groupBy("source_id").agg(F.count_if("located").alias("located"), F.count(F.lit(1)).alias("excerpts"), F.count_distinct("cand_id").alias("candidates"))
    return a.withColumn("line", F.format_string("located %d/%d across %d candidates", "located", "excerpts", "candidates"))


@query(with_values("candidates", "evidence", "subsections") + """, m AS (SELECT DISTINCT e.source_id, e.cand_id, s.heading FROM evidence e JOIN subsections s ON s.source_id = e.source_id AND e.located AND e.start >= s.start AND e."end" <= s."end")
 SELECT source_id, cand_id, title, coalesce((SELECT string_agg(heading, '|' ORDER BY heading) FROM m WHERE m.source_id = c.source_id AND m.cand_id = c.cand_id), '') AS method_subsection_evidence FROM candidates c""")
def curator_input(spark, d):
    """Headings only, no source text"""
    c, e, s = _base(spark)
    sub = s.select(F.col("source_id").alias("ss"), "heading", F.col("start").alias("a"), F.col("end").alias("b"))
    m = e.where("located").join(sub, (F.col("source_id") == F.col("ss")) & (F.col("start") >= F.col("a")) & (F.col("end") <= F.col("b"))).groupBy("source_id", "cand_id").agg(
        F.array_join(F.array_sort(F.collect_set("heading")), "|").alias("method_subsection_evidence"))
    return c.join(m, ["source_id", "cand_id"], "left").select("source_id", "cand_id", "title", F.coalesce("method_subsection_evidence", F.lit("")).alias("method_subsection_evidence"))


@query(with_values("subsections") + """, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start) AS n, count(*) OVER (PARTITION BY source_id) AS total FROM subsections)
 SELECT source_id, string_agg(heading, ', ' ORDER BY n) FILTER (n <= 5) || CASE WHEN any_value(total) > 5 THEN ' +' || (any_value(total) - 5) || ' more' ELSE '' END AS line FROM r GROUP BY 1""")
def report_rows(spark, d):
    """F19, L6"""
    a = frame(spark, "subsections").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("start", "heading"))).alias("x"))
    more = F.when(F.size("x") > C.MAX_IN_SPAN, F.format_string(" +%d more", F.size("x") - C.MAX_IN_SPAN)).otherwise("")
    return a.select("source_id", F.concat(F.array_join(F.slice("x", 1, C.MAX_IN_SPAN)["heading"], ", "), more).alias("line"))


@query(with_values("candidates", "notes") + f""", k AS (SELECT {ident('title')} AS key, count(*) AS n, min(origin) AS origin, min(human_verified) AS hv FROM notes GROUP BY 1)
 SELECT source_id, cand_id, title, CASE WHEN n IS NULL THEN 'create' WHEN n > 1 OR origin = 'me' OR hv NOT IN ('true', 'false') THEN 'unprocessed' WHEN hv <> 'false' THEN 'skip' ELSE 'update' END AS action
 FROM candidates c LEFT JOIN k ON key = {ident('c.title')}""")
def note_actions(spark, d):
    """J6, P15, S12, V9"""
    return N.actions(frame(spark, "candidates"), frame(spark, "notes"))


LINKS = ", e AS (SELECT title AS src, unnest(regexp_extract_all(body, '\\[\\[([^\\]\\[|]+)(?:\\|[^\\]\\[]*)?\\]\\]', 1)) AS dst FROM notes)"


@query(with_values("notes") + LINKS + " SELECT src, dst, CASE WHEN EXISTS (SELECT 1 FROM notes n WHERE n.title = e.dst) THEN '[[' || dst || ']]' ELSE dst || ' (suggested)' END AS shown FROM e")
def related_links(spark, d):
    """F17, G9, J7"""
    n = frame(spark, "notes")
    known = n.select(F.col("title").alias("dst")).distinct().withColumn("hit", F.lit(True))
    return N.edges(n).join(known, "dst", "left").select("src", "dst", F.when(F.col("hit"), X.wikilink(F.col("dst"))).otherwise(F.concat("dst", F.lit(" (suggested)"))).alias("shown"))


@query(with_values("notes") + LINKS + " SELECT n.title, count(e.src) AS backlinks FROM notes n LEFT JOIN e ON e.dst = n.title GROUP BY 1")
def backlinks(spark, d):
    """J13"""
    n = frame(spark, "notes")
    return n.select("title").join(N.edges(n).withColumnRenamed("dst", "title"), "title", "left").groupBy("title").agg(F.count("src").alias("backlinks"))


@query(with_values("notes", "sources") + " SELECT path, regexp_extract(sources, '\\[\\[(.*)\\]\\]', 1) AS missing FROM notes n WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.title = regexp_extract(n.sources, '\\[\\[(.*)\\]\\]', 1))")
def missing_sources(spark, d):
    """J8"""
    cited = frame(spark, "notes").select("path", F.explode(X.link_targets(F.col("sources"))).alias("missing"))
    return cited.join(frame(spark, "sources"), F.col("missing") == F.col("title"), "left_anti")


@query(with_values("notes") + f" SELECT path, regexp_matches(path, '^{C.WIKI_DIR}/[^/]+\\.md$') AND type = 'concept' AND origin = 'ai' AS writable FROM notes")
def write_scope(spark, d):
    """P16"""
    return frame(spark, "notes").select("path", (N.in_wiki(F.col("path")) & (F.col("type") == "concept") & (F.col("origin") == "ai")).alias("writable"))


@query(with_values("notes", "sources", "evidence") + """, ev AS (SELECT source_id, count(*) AS total, count(*) FILTER (located) AS verbatim FROM evidence GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY path) AS source_id FROM notes)
 SELECT path, coalesce(verbatim, 0) AS verbatim, coalesce(total, 0) AS total, EXISTS (SELECT 1 FROM sources s WHERE '[[' || s.title || ']]' = n.sources) AND coalesce(total, 0) > 0 AND human_verified = 'false' AS marked,
 format('Verification: {} of {} excerpts verbatim', coalesce(verbatim, 0), coalesce(total, 0)) AS line FROM n LEFT JOIN ev USING (source_id)""")
def verify_note(spark, d):
    """V8, A11"""
    ev = frame(spark, "evidence").groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("located").alias("verbatim"))
    n = frame(spark, "notes").withColumn("source_id", F.row_number().over(Window.orderBy("path")).cast("bigint"))
    known = frame(spark, "sources").select(X.wikilink(F.col("title")).alias("sources"), F.lit(True).alias("known"))
    x = n.join(ev, "source_id", "left").join(known, "sources", "left").fillna(0, ["total", "verbatim"]).fillna(False, ["known"])
    return x.select("path", "verbatim", "total", (F.col("known") & (F.col("total") > 0) & (F.col("human_verified") == "false")).alias("marked"),
                    F.format_string("Verification: %d of %d excerpts verbatim", "verbatim", "total").alias("line"))


@query(with_values("notes") + """ SELECT title, sha256('---' || chr(10) || 'type: concept' || chr(10) || 'origin: ai' || chr(10) || 'knowledge_status: processed' || chr(10) || 'domain:' || chr(10) || '  - alpha' || chr(10) || '  - beta' || chr(10) || 'sources:' || chr(10)
 || '  - "' || sources || '"' || chr(10) || 'human_verified: false' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || '## Definition' || chr(10) || chr(10) || body || chr(10) || chr(10) || '## Key Points' || chr(10) || chr(10)
 || '- one' || chr(10) || '- two' || chr(10) || chr(10) || '## Related Concepts' || chr(10) || chr(10) || '- [[Gate]]' || chr(10) || chr(10) || '## Provenance' || chr(10) || chr(10) || 'Model: fake' || chr(10)) AS note_sha256 FROM notes""")
def render_note(spark, d):
    """S14, F20, L8"""
    s = lambda *x: F.array(*map(F.lit, x))
    note = N.render(F.col("title"), s("beta", "alpha", "beta"), X.link_targets(F.col("sources")), F.col("body"), s("one", "two"), s("[[Gate]]"), F.lit("fake"))
    return frame(spark, "notes").select("title", X.sha256(note).alias("note_sha256"))


@query(with_values("notes") + " SELECT title, array_to_string(list_sort(list_distinct(['S One', regexp_extract(sources, '\\[\\[(.*)\\]\\]', 1)])), '|') AS united FROM notes")
def merge_sources(spark, d):
    """Provenance only grows"""
    return frame(spark, "notes").select("title", F.array_join(F.array_sort(F.array_union(F.array(F.lit("S One")), X.link_targets(F.col("sources")))), "|").alias("united"))


@query(with_values("frontmatter") + r""" SELECT id, concat_ws(',', CASE WHEN type IS NULL OR origin IS NULL OR knowledge_status IS NULL THEN 'required' END,
 CASE WHEN coalesce(type NOT IN ('source','concept','project','area','decision','idea','question','daily','meeting','person','report','template','index'), true) THEN 'type' END,
 CASE WHEN coalesce(origin NOT IN ('external','me','ai'), true) THEN 'origin' END, CASE WHEN origin = 'ai' AND knowledge_status <> 'processed' THEN 'authority' END,
 CASE WHEN NOT regexp_matches(domain, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'domain' END, CASE WHEN TRY_CAST(created AS DATE) IS NULL THEN 'created' END,
 CASE WHEN source_url IS NOT NULL AND NOT regexp_matches(source_url, '^https?://[^/ ]+') THEN 'source_url' END, CASE WHEN starts_with(source_file, '/') THEN 'source_file' END,
 CASE WHEN human_verified NOT IN ('true','false') THEN 'human_verified' END) AS reasons FROM frontmatter""")
def frontmatter_check(spark, d):
    """N4, F18"""
    return N.property_reasons(frame(spark, "frontmatter"))


@query(with_values("relations") + f""" SELECT id, CASE WHEN a = b THEN 'supports' WHEN trim(regexp_replace(regexp_replace(b, '\\b(not|no|never)\\b', '', 'g'), ' +', ' ', 'g')) = a THEN 'contradicts' WHEN starts_with(b, a || ' ') THEN 'extends' END AS relation
 FROM (SELECT id, {ident('old_claim')} AS a, {ident('new_claim')} AS b FROM relations)""")
def relations(spark, d):
    """N5"""
    return frame(spark, "relations").select("id", N.relation(F.col("old_claim"), F.col("new_claim")).alias("relation"))


@query(with_values("plans") + f""" SELECT plan_id, r = '' AS accepted, r AS reasons FROM (SELECT plan_id, concat_ws(',', CASE WHEN digest IS DISTINCT FROM found_digest THEN 'digest' END, CASE WHEN version <> 6 THEN 'view_version' END,
 CASE WHEN source_hash IS DISTINCT FROM found_hash THEN 'source_changed' END, CASE WHEN NOT regexp_matches(path, '^{C.WIKI_DIR}/[^/]+\\.md$') THEN 'target' END, CASE WHEN action = 'create' AND found_base IS NOT NULL THEN 'target_exists' END,
 CASE WHEN action = 'update' AND (base IS DISTINCT FROM found_base OR owner IS DISTINCT FROM 'ai') THEN 'base_changed' END, CASE WHEN spent THEN 'spent' END) AS r FROM plans)""")
def plan_preconditions(spark, d):
    """S17, V1, V2, V3, V4, V5, V6, V7, J12"""
    return N.plan_reasons(frame(spark, "plans"))


@query(with_values("old_sources", "new_sources") + """ SELECT source_id, coalesce(n.content, o.content) AS content, coalesce(nullif(o.extra, ''), n.extra, '') AS extra, coalesce(highlights, '') AS highlights, coalesce(related, '') AS related,
 CASE WHEN o.content IS NULL THEN 'create' WHEN n.content IS NULL THEN 'missing' WHEN o.content = n.content THEN 'same' ELSE 'replace' END AS status FROM old_sources o FULL JOIN new_sources n USING (source_id)""")
def replace_merge(spark, d):
    """S5, S6"""
    return N.replace_sources(frame(spark, "old_sources"), frame(spark, "new_sources"))


@query(with_values("configs") + r""", k AS (SELECT *, regexp_extract(lower(base_url), '^https?://(\[[0-9a-f:]+\]|[^/:@?#\[\]]+)(:[0-9]+)?([/?#]|$)', 1) IN ('localhost', '127.0.0.1', '[::1]', '::1') AS allowed,
 TRY_CAST(regexp_extract(keep_alive, '^([0-9]{1,6})(s|m)?$', 1) AS INTEGER) * CASE WHEN regexp_extract(keep_alive, '^([0-9]{1,6})(s|m)?$', 2) = 'm' THEN 60 ELSE 1 END AS v FROM configs)
 SELECT id, allowed, CASE WHEN v <= 3600 THEN v END AS keep_alive_s FROM k""")
def loopback_guard(spark, d):
    """S23, S24"""
    return frame(spark, "configs").select("id", X.is_loopback(F.col("base_url")).alias("allowed"), X.keep_alive_seconds(F.col("keep_alive")).alias("keep_alive_s"))


LOCAL = r"coalesce(regexp_extract(lower({x}), '^https?://(\[[0-9a-f:]+\]|[^/:@?#\[\]]+)(:[0-9]+)?([/?#]|$)', 1) IN ('localhost', '127.0.0.1', '[::1]', '::1'), false)"


@query(with_values("endpoints") + f""" SELECT id, r = '' AS allowed, r AS reasons, CASE WHEN enabled AND llm_calls > 0 AND exit_code IN (0, 5, 6) THEN 1 ELSE 0 END AS unload_requests
 FROM (SELECT *, concat_ws(',', CASE WHEN NOT {LOCAL.format(x='base_url')} THEN 'remote_host' END, CASE WHEN coalesce(proxy, '') <> '' THEN 'proxy' END,
 CASE WHEN redirect IS NOT NULL AND NOT {LOCAL.format(x='redirect')} THEN 'redirect' END, CASE WHEN regexp_matches(lower(model), '[:-]cloud$') THEN 'cloud_model' END) AS r FROM endpoints)""")
def endpoint_guard(spark, d):
    """Remote hosts, proxies, redirects and cloud models are refused; one unload request under its rule"""
    r = X.endpoint_reasons(F.col("base_url"), F.col("proxy"), F.col("redirect"), F.col("model"))
    return frame(spark, "endpoints").select(
        "id", (r == "").alias("allowed"), r.alias("reasons"), X.unload_requests(F.col("enabled"), F.col("llm_calls"), F.col("exit_code")).alias("unload_requests"))


@query(with_values("runs") + """ SELECT source_id, chunks + curator + recovery AS llm_calls, CASE WHEN low_text THEN 3 WHEN failures > 0 THEN 5 WHEN gate = 'failed' THEN 6 ELSE 0 END AS exit_code,
 bool_or(failures > 0 OR gate = 'failed' OR low_text) OVER () AS writes_blocked FROM runs""")
def exit_code(spark, d):
    """A4, A12, A13"""
    r = frame(spark, "runs")
    code = A.exit_code(F.col("failures"), F.col("low_text"), F.col("gate") == "failed")
    whole = r.agg(F.bool_or((F.col("failures") > 0) | (F.col("gate") == "failed") | F.col("low_text")).alias("writes_blocked"))
    return r.select("source_id", (F.col("chunks") + F.col("curator") + F.col("recovery")).alias("llm_calls"), code.alias("exit_code")).crossJoin(F.broadcast(whole))


@query(with_values("runs") + """ SELECT sum(chunks)::BIGINT AS chunks, sum(curator)::BIGINT AS curator_calls, sum(recovery)::BIGINT AS recovery_calls, sum(repairs)::BIGINT AS json_repairs, sum(timeouts)::BIGINT AS timeouts, max(CASE WHEN chunks > 0 THEN 1 ELSE 0 END)::BIGINT AS unload_requests FROM runs""")
def run_counters(spark, d):
    """A3, S25"""
    s = lambda c, n: F.sum(c).alias(n)
    return frame(spark, "runs").agg(s("chunks", "chunks"), s("curator", "curator_calls"), s("recovery", "recovery_calls"), s("repairs", "json_repairs"), s("timeouts", "timeouts"),
                                    F.max(F.when(F.col("chunks") > 0, 1).otherwise(0)).cast("bigint").alias("unload_requests"))


@query("SELECT * FROM (VALUES (1::BIGINT, 'ok', 'Gate'), (2, 'repaired', 'Gate'), (3, 'failed', NULL), (4, 'failed', NULL), (5, 'failed', NULL), (6, 'failed', NULL), (7, 'failed', NULL)) AS v(id, status, title)")
def schema_check(spark, d):
    """N1, N2, N3"""
    return E.check_replies(frame(spark, "replies")).select("id", "status", F.col("concept.title").alias("title"))


@query(with_values("proposals") + " SELECT id, coalesce(target <> '' AND change <> '' AND reason <> '' AND sources <> '' AND part <> '', false) AS complete FROM proposals")
def proposals(spark, d):
    """Suggestions name target, change, reason, sources and part"""
    full = None
    for c in ("target", "change", "reason", "sources", "part"):
        t = F.col(c) != ""
        full = t if full is None else full & t
    return frame(spark, "proposals").select("id", F.coalesce(full, F.lit(False)).alias("complete"))


@query(with_values("notes") + f""" SELECT path, CASE WHEN starts_with(path, '{C.WIKI_DIR}/') THEN true ELSE false END AS can_write FROM notes""")
def ownership_zones(spark, d):
    """Write zones by path prefix; no zone, no write"""
    zones = spark.createDataFrame([(C.WIKI_DIR + "/", True), ("Library/Sources/", False), ("Library/Knowledge/", False)], "prefix string, can_write boolean")
    n = frame(spark, "notes").select("path")
    return n.join(F.broadcast(zones), F.startswith(F.col("path"), F.col("prefix")), "left").groupBy("path").agg(F.coalesce(F.bool_or("can_write"), F.lit(False)).alias("can_write"))
