"""Notes: actions, links, rendering, verification, plans and their preconditions, properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scrivenry import config as C
from scrivenry.functions import text as X


def in_wiki(path: Column) -> Column:
    return path.rlike("^" + C.WIKI_DIR + r"/[^/]+\.md$")


def actions(cands: DataFrame, notes: DataFrame) -> DataFrame:
    """create, update, skip (protected concept) or unprocessed (the source stays open), by identity."""
    keyed = notes.withColumn("key", X.identity(F.col("title"))).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("origin").alias("origin"), F.min("human_verified").alias("human_verified"))
    x = cands.withColumn("key", X.identity(F.col("title"))).join(keyed, "key", "left")
    what = (
        F.when(F.col("n").isNull(), "create").when(F.col("n") > 1, "unprocessed").when(F.col("origin") == "me", "unprocessed")
        .when(~F.col("human_verified").isin("true", "false"), "unprocessed").when(F.col("human_verified") != "false", "skip").otherwise("update"))
    return x.select("source_id", "cand_id", "title", what.alias("action"))


def edges(notes: DataFrame) -> DataFrame:
    """(src, dst): links of note bodies."""
    return notes.select(F.col("title").alias("src"), F.explode(X.link_targets(F.col("body"))).alias("dst"))


def render(
    title: Column, domain: Column, sources: Column, definition: Column, points: Column, related: Column, model: Column,
    core_idea: Column | None = None, mechanism: Column | None = None, evidence: Column | None = None, questions: Column | None = None,
    created: Column | None = None,
) -> Column:
    """Markdown of a concept note: properties, nine sections and Provenance. Nothing is cut.

    Domains are sorted, evidence (claim, source, excerpt, chunk) is numbered. A section whose column is not given is
    left out; one without content says so.
    """
    lines = lambda a: F.array_join(a, "\n")
    bullet = lambda a: lines(F.transform(a, lambda x: F.concat(F.lit("- "), x)))
    filled = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("(none)"))

    def section(name: str, body: Column | None) -> list[Column]:
        return [] if body is None else [F.lit(f"\n\n## {name}\n\n"), body]

    def cited(e: Column, i: Column) -> Column:
        return F.concat(F.lit("### Evidence "), (i + 1).cast("string"), F.lit("\n\n- Claim: "), e["claim"], F.lit("\n- Source: "), X.wikilink(e["source"]),
                        F.lit("\n- Excerpt: "), e["excerpt"], F.lit("\n- Chunk: "), e["chunk"])

    dated = F.lit("") if created is None else F.concat(F.lit("\ncreated: "), created, F.lit("\nupdated: "), created)
    return F.concat(
        F.lit("---\ntype: concept\norigin: ai\nknowledge_status: processed\ndomain:\n"),
        lines(F.transform(F.array_sort(F.array_distinct(domain)), lambda x: F.concat(F.lit("  - "), x))), dated,
        F.lit("\nsources:\n"), lines(F.transform(sources, lambda x: F.concat(F.lit('  - "'), X.wikilink(x), F.lit('"')))),
        F.lit("\nhuman_verified: false\n---\n\n# "), title, *section("Definition", definition),
        *section("Core Idea", None if core_idea is None else filled(core_idea)), *section("Mechanism", None if mechanism is None else filled(mechanism)),
        *section("Key Points", bullet(points)), *section("Related Concepts", bullet(related)),
        *section("Evidence", None if evidence is None else filled(F.array_join(F.transform(evidence, cited), "\n\n"))),
        *section("Sources", None if evidence is None else bullet(F.transform(sources, X.wikilink))),
        *section("Open Questions", None if questions is None else filled(bullet(questions))),
        *section("Provenance", F.concat(F.lit("Model: "), model)), F.lit("\n"))


def plan_reasons(plans: DataFrame) -> DataFrame:
    """(plan_id, accepted, reasons): every broken precondition is named; null-safe comparisons."""
    create, update = F.col("action") == "create", F.col("action") == "update"
    reasons = F.array_compact(F.array(
        F.when(~F.col("digest").eqNullSafe(F.col("found_digest")), "digest"), F.when(F.col("version") != C.VIEW_VERSION, "view_version"),
        F.when(~F.col("source_hash").eqNullSafe(F.col("found_hash")), "source_changed"), F.when(~in_wiki(F.col("path")), "target"),
        F.when(create & F.col("found_base").isNotNull(), "target_exists"),
        F.when(update & ~(F.col("base").eqNullSafe(F.col("found_base")) & F.col("owner").eqNullSafe(F.lit("ai"))), "base_changed"),
        F.when(F.col("spent"), "spent")))
    return plans.select("plan_id", (F.size(reasons) == 0).alias("accepted"), F.array_join(reasons, ",").alias("reasons"))


def mark_verified(notes: DataFrame, found: DataFrame, sources: DataFrame, reviewer: str) -> DataFrame:
    """``notes`` with ``human_verified`` and a Verification line where their source exists and has excerpts.

    ``found`` has (doc_id, hit) of the located excerpts, ``sources`` (doc_id). Only machine-written notes that no
    one has marked yet change; the reviewer, who judged the claims, is named, and ``verified_by`` says who wrote the mark.
    """
    each = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"), F.count_if("hit").alias("__k"))
    known = sources.select("doc_id").distinct().withColumn("__known", F.lit(True))
    x = notes.join(each, "doc_id", "left").join(known, "doc_id", "left")
    ours = F.coalesce(F.col("__known") & (F.col("__n") > 0) & (F.col("origin") == "ai") & (F.col("human_verified") == "false"), F.lit(False))
    line = F.concat(F.col("body"), F.lit("\n"), F.format_string("Verification: %d of %d excerpts verbatim, by ", "__k", "__n"), F.lit(reviewer), F.lit("\n"))
    by = F.when(ours, "ai").otherwise(F.col("verified_by") if "verified_by" in notes.columns else F.lit(None).cast("string"))
    return x.withColumn("body", F.when(ours, line).otherwise(F.col("body"))).withColumn("verified_by", by).withColumn(
        "human_verified", F.when(ours, "true").otherwise(F.col("human_verified"))).drop("__n", "__k", "__known")


def property_reasons(fm: DataFrame) -> DataFrame:
    """(id, reasons) of properties that break the contract."""
    c = F.col
    reasons = F.array_compact(F.array(
        F.when(c("type").isNull() | c("origin").isNull() | c("knowledge_status").isNull(), "required"),
        F.when(~F.coalesce(c("type").isin(*C.NOTE_TYPES), F.lit(False)), "type"), F.when(~F.coalesce(c("origin").isin(*C.ORIGINS), F.lit(False)), "origin"),
        F.when((c("origin") == "ai") & (c("knowledge_status") != "processed"), "authority"),
        F.when(~c("domain").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "domain"), F.when(F.try_to_date("created", "yyyy-MM-dd").isNull(), "created"),
        F.when(c("source_url").isNotNull() & ~c("source_url").rlike("^https?://[^/ ]+"), "source_url"), F.when(c("source_file").rlike("^/"), "source_file"),
        F.when(~c("human_verified").isin("true", "false"), "human_verified")))
    return fm.select("id", F.array_join(reasons, ",").alias("reasons"))


def replace_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """A new extraction takes the content; what people wrote (extra properties, highlights, relations) stays."""
    o = old.select("source_id", F.col("content").alias("o"), F.col("extra").alias("oe"), "highlights", "related")
    j = new.select("source_id", F.col("content").alias("n"), F.col("extra").alias("ne")).join(o, "source_id", "full")
    status = F.when(F.col("o").isNull(), "create").when(F.col("n").isNull(), "missing").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise("replace")
    return j.select("source_id", F.coalesce("n", "o").alias("content"), F.coalesce(F.nullif("oe", F.lit("")), "ne", F.lit("")).alias("extra"),
                    F.coalesce("highlights", F.lit("")).alias("highlights"), F.coalesce("related", F.lit("")).alias("related"), status.alias("status"))


def relation(old: Column, new: Column) -> Column:
    """Conservative (ours): equal claims support, a claim that goes on extends, an added ``not`` contradicts, else null."""
    a, b = X.identity(old), X.identity(new)
    plain = F.trim(F.regexp_replace(F.regexp_replace(b, r"\b(not|no|never)\b", ""), " +", " "))
    return F.when(a == b, "supports").when((plain == a) & (b != a), "contradicts").when(F.startswith(b, F.concat(a, F.lit(" "))), "extends")
