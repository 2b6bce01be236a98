"""Queries through files, providers and plans, with the SQL of what must come back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from scrivenry.functions import text as X
from scrivenry.operators import chunks as K, extract as E
from scrivenry.plans.document_queries import FOLD, _sql_markdown
from scrivenry.plans.fixtures import frame, with_values
from scrivenry.sources import markdown as M, pages as P, sinks as S
from scrivenry.sources.tables import shared_dir, table


QUERIES = {}
ORACLES = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT page_id, url AS source_url, false AS verified, sha256({_sql_markdown('html')}) AS content_sha256 FROM pages")
def note_scan(spark, d):
    """Every page as a whole Markdown note in a file of its own, read back, properties and sections parsed"""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    front = F.concat(F.lit("---\ntype: source\npage_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("\nsource_url: "),
                     F.coalesce(quoted(F.col("url")), F.lit("null")), F.lit("\nhuman_verified: false\n---\n"))
    # a page without HTML has no content, which is not an empty one
    body = F.coalesce(P.note_body(P.title(F.col("html")), F.coalesce("url", F.lit("")), P.to_markdown(F.col("html"))), F.lit(""))
    raw = S.through_files(table(spark, d, "pages").select(F.concat(front, body).alias("value")), _path(spark, "notes"), ".md")
    parsed = raw.select(M.parse_properties(F.regexp_extract("value", M.FRONT, 1)).alias("p"), F.regexp_extract("value", M.FRONT, 2).alias("body"))
    return parsed.select(
        F.col("p")["page_id"].cast("bigint").alias("page_id"), F.col("p")["source_url"].alias("source_url"),
        (F.col("p")["human_verified"] == "true").alias("verified"),
        F.when(F.col("body") != "", X.sha256(M.content(F.col("body")))).alias("content_sha256"))


@query(r"""SELECT doc_id, 'plain' AS extraction_method, CASE WHEN low THEN 3 ELSE 0 END AS exit_code, CASE WHEN NOT low THEN sha256(
 replace(replace(replace(replace(t, '\<', '<'), '\>', '>'), '<', '&lt;'), '>', '&gt;')) END AS content_sha256
 FROM (SELECT doc_id, coalesce(text, '') AS t, length(trim(coalesce(text, ''))) < 200 AS low FROM documents)""")
def ingest_files(spark, d):
    """Every document as a file through an extractor; those with little text are refused, null is empty"""
    # a file is a row of path and bytes, so no file holds more than one document
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    found = M.extract(files)
    return found.select(F.col("source_file").cast("bigint").alias("doc_id"), "extraction_method", "exit_code", X.sha256(F.col("content")).alias("content_sha256"))


@query(FOLD + r""", t AS (
  SELECT c.doc_id, chunk_no, substr(text, "start" + 1, "end" - "start") AS t FROM chunked c JOIN documents USING (doc_id)
), a AS (SELECT doc_id, chunk_no, length(t) AS n, substr(split_part(regexp_replace(t, '^\s+|\s+$', '', 'g'), '.', 1), 1, 60) AS title FROM t),
s AS (SELECT *, CASE WHEN trim(title) = '' THEN 'failed' WHEN n % 3 = 0 THEN 'repaired' WHEN n % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM a)
SELECT doc_id, chunk_no, status, CASE WHEN status <> 'failed' THEN title END AS title FROM s""")
def provider_extract(spark, d):
    """Replies of an injected provider for every chunk, checked strictly"""
    def provider(text: str) -> str:
        title = text.strip().split(".")[0][:60]
        reply = json.dumps({"title": title, "role": "concept", "definition": title, "key_points": [], "evidence": [{"claim": title, "excerpt": text[:80]}]})
        return f"```json\n{reply}\n```" if len(text) % 3 == 0 else reply[:-5] if len(text) % 7 == 0 else reply

    replies = E.extract(K.chunks(table(spark, d, "documents"), "doc_id"), provider, "doc_id")
    return E.check_replies(replies).select("doc_id", "chunk_no", "status", F.col("concept.title").alias("title"))


@query(with_values("replies") + " SELECT id, 'failed' AS status, CAST(length(reply) AS BIGINT) AS reply_chars, sha256(reply) AS reply_sha256 FROM replies WHERE id >= 3")
def failure_diagnostics(spark, d):
    """Failures as JSON without any source text"""
    path = _path(spark, "diagnostics")
    S.write_diagnostics(E.check_replies(frame(spark, "replies")).where("status = 'failed'"), path)
    return spark.read.schema("id bigint, status string, reply_chars bigint, reply_sha256 string").json(path)


@query(with_values("notes") + " SELECT path, 'create' AS action, true AS intact FROM notes")
def plan_round_trip(spark, d):
    """A plan saved in one step, read back, its digest proven"""
    path = _path(spark, "plan")
    notes = frame(spark, "notes").select("path", F.lit("create").alias("action"), F.col("body").alias("content"), F.lit(None).cast("string").alias("base"))
    digest = S.save_plan(notes, path)
    plan = S.read_plan(spark, path)
    return plan.select("path", "action", (F.lit(S.plan_digest(plan)) == F.lit(digest)).alias("intact"))


@query("SELECT l.doc_id AS source_id, CASE WHEN d.doc_id IS NULL THEN 'old' ELSE sha256(d.text) END AS content_hash FROM labels l LEFT JOIN documents d USING (doc_id)")
def processing_state(spark, d):
    """The state after a run keeps other sources and replaces processed ones"""
    now = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), X.sha256(F.col("text")).alias("content_hash"))
    old = table(spark, d, "labels").select(F.col("doc_id").alias("source_id"), F.lit("old").alias("content_hash"))
    return S.next_state(old, now.join(old.select("source_id"), "source_id", "left_semi"))
