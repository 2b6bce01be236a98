"""Command line: ``ingest``, ``scan``, ``apply`` and ``verify`` over Parquet tables and Markdown folders."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from scrivenry import config as C
from scrivenry.functions import text as X
from scrivenry.operators import notes as N, scan as R
from scrivenry.operators.locate import locate
from scrivenry.sources import markdown as M, sinks as S
from scrivenry.sources.tables import materialise


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="scrivenry")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="files -> source table; a dry run unless --write")
    a.add_argument("path")
    a.add_argument("--extractor", default=M.default_extractor(), choices=sorted(M.EXTRACTORS))
    a.add_argument("--write")
    a.add_argument("--replace", action="store_true", help="let new extractions take the place of sources that are there")
    a = sub.add_parser("scan", help="sources (doc_id, text) -> planned concept notes")
    a.add_argument("table")
    a.add_argument("--source")
    a.add_argument("--notes", help="table (path, title, origin, human_verified, body) of the notes there are")
    a.add_argument("--state", help="table (source_id, content_hash) of processed sources; --write brings it up to date")
    a.add_argument("--save-plan")
    a.add_argument("--write")
    a = sub.add_parser("apply", help="check a saved plan and write exactly it")
    a.add_argument("plan")
    a.add_argument("--digest", required=True)
    a.add_argument("--sources", help="table (doc_id, text) as it is now; with it every precondition is checked")
    a.add_argument("--notes")
    a.add_argument("--spent", help="table (digest) of applied plans; --write adds this one")
    a.add_argument("--write")
    a = sub.add_parser("verify", help="locate excerpts (doc_id, excerpt) in sources (doc_id, text)")
    a.add_argument("table")
    a.add_argument("excerpts")
    a.add_argument("--notes", help="table (path, title, origin, human_verified, body, doc_id) whose excerpts these are")
    a.add_argument("--reviewer")
    a.add_argument("--write", help="where the marked notes go")
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    return {"ingest": ingest, "scan": scan, "apply": apply, "verify": verify}[args.command](spark, args)


def _read(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """The current table at ``path``, or an empty one."""
    if path is None or not S.exists(spark, path):
        return spark.createDataFrame([], schema)
    return S.read_current(spark, path)


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    found = M.ingest(spark, args.path, args.extractor)
    bad = found.where("exit_code <> 0").count()
    print(f"files={found.count()} refused={bad}")
    if bad:
        return C.EXITS["ocr"]
    held = _read(spark, args.write, "source_file string, content string") if args.write else None
    if held is not None and S.exists(spark, args.write):
        changed = held.join(found.select("source_file", F.col("content").alias("new")), "source_file").where(~F.col("content").eqNullSafe(F.col("new"))).count()
        print(f"changed={changed}")
        if changed and not args.replace:
            print("sources are there already; --replace lets new extractions take their place")
            return C.EXITS["unexpected"]
        found = found.unionByName(held.join(found, "source_file", "left_anti"), allowMissingColumns=True)
    if args.write:
        S.write_atomic(found, args.write)
    return C.EXITS["ok"]


def scan(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = spark.read.parquet(args.table)
    if args.source:
        docs = docs.where(F.col("doc_id") == args.source)
    title = F.col("title") if "title" in docs.columns else F.concat_ws(" ", F.lit("document"), F.col("doc_id").cast("string"))
    sources = docs.select(F.col("doc_id").alias("source_id"), title.alias("title"), "text")
    notes = _read(spark, args.notes, "path string, title string, origin string, human_verified string, body string")
    kind = sources.schema["source_id"].dataType.simpleString()
    state = _read(spark, args.state, f"source_id {kind}, content_hash string")
    got = R.scan(sources, notes=notes, state=state)
    code = got.exit_code()
    plan = got.plan.where("content is not null")
    print(f"planned={plan.count()} failed={got.report.where('exit_code <> 0').count()} exit={code}")
    if args.save_plan:
        try:
            print(f"digest={S.save_plan(plan, args.save_plan, write=bool(args.write), exit_code=code)}")
        except ValueError as e:
            print(e)
            return code or C.EXITS["technical"]
    elif args.write and code == C.EXITS["ok"]:
        S.write_atomic(plan.select("path", "content"), args.write)
        if args.state:
            S.write_atomic(materialise(S.next_state(state, got.report.select("source_id", "content_hash")), "state"), args.state)
    return code


def apply(spark: SparkSession, args: argparse.Namespace) -> int:
    plan = S.read_plan(spark, args.plan)
    if S.plan_digest(plan) != args.digest or not plan.where(F.col("digest") != args.digest).isEmpty():
        print("the plan was changed")
        return C.EXITS["technical"]
    print(f"notes={plan.count()}")
    spent = _read(spark, args.spent, "digest string")
    if args.sources:
        state = spark.read.parquet(args.sources).select(
            F.col("doc_id").alias("source_id"), X.sha256(F.coalesce("text", F.lit(""))).alias("content_hash"))
        notes = _read(spark, args.notes, "path string, title string, origin string, human_verified string, body string")
        checks = S.plan_checks(plan, args.digest, state, notes.withColumnRenamed("body", "content"), spent)
        bad = N.plan_reasons(checks).where(~F.col("accepted"))
        if not bad.isEmpty():
            for r in bad.groupBy("reasons").count().orderBy("reasons").limit(C.MAX_REPORT_ROWS).collect():
                print(f"{r['count']} notes: {r['reasons']}")
            return C.EXITS["technical"]
    elif not spent.where(F.col("digest") == args.digest).isEmpty():
        print("the plan was applied before")
        return C.EXITS["technical"]
    if args.write:
        S.write_atomic(plan.select("path", "content"), args.write)
        if args.spent:
            S.write_atomic(materialise(spent.union(spark.createDataFrame([(args.digest,)], "digest string")), "spent"), args.spent)
    return C.EXITS["ok"]


def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = spark.read.parquet(args.table).select("doc_id", F.col("text").alias("content"))
    found = locate(spark.read.parquet(args.excerpts).select("doc_id", "excerpt"), docs, "doc_id").withColumn("hit", F.col("start").isNotNull())
    r = found.agg(F.count_if("hit").alias("k"), F.count(F.lit(1)).alias("n")).first()
    print(f"Verification: {r['k']} of {r['n']} excerpts verbatim")
    if args.write:
        if not args.notes or not args.reviewer:
            print("--write needs --notes and --reviewer")
            return C.EXITS["unexpected"]
        S.write_atomic(N.mark_verified(spark.read.parquet(args.notes), found, docs, args.reviewer), args.write)
    return C.EXITS["ok"]


if __name__ == "__main__":
    sys.exit(main())
