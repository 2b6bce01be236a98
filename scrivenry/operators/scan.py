"""The main path: sources -> view -> chunks -> concepts -> merge -> roles -> recovery -> curator -> gate -> plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from scrivenry import config as C
from scrivenry.functions import text as X
from scrivenry.operators import candidates as A, chunks as K, coverage as V, extract as E, headings as H, notes as N, view as L
from scrivenry.operators.locate import locate
from scrivenry.sources.tables import materialise

#: Chunk numbers of targeted calls start here, after those of general ones.
TARGETED = 1_000_000
EVIDENCE = "array<struct<chunk_no:bigint,chunk:string,claim:string,excerpt:string>>"


@dataclass
class Scan:
    """What a run makes; every member is a DataFrame keyed by source_id."""

    view: DataFrame
    chunks: DataFrame
    candidates: DataFrame
    evidence: DataFrame
    subsections: DataFrame
    gate: DataFrame
    plan: DataFrame
    report: DataFrame

    def exit_code(self) -> int:
        """One code for the run; any failure blocks all writes."""
        r = self.report.agg(F.bool_or(F.col("exit_code") == C.EXITS["ocr"]), F.bool_or(F.col("exit_code") == C.EXITS["technical"]),
                            F.bool_or(F.col("exit_code") == C.EXITS["quality"])).first()
        return next((C.EXITS[k] for k, v in zip(("ocr", "technical", "quality"), r) if v), C.EXITS["ok"])


def _concepts(chunks: DataFrame, provider: Callable[[str], str] | None) -> DataFrame:
    """Checked replies of the provider (None: the fake one, in the JVM) for chunks (source_id, chunk_no, chunk_id, text)."""
    if provider is None:
        replies = chunks.select("source_id", "chunk_no", E.fake_reply(F.col("text")).alias("reply"), F.lit(None).cast("string").alias("failure"), "chunk_id")
    else:
        replies = E.extract(chunks, provider, "source_id").join(chunks.select("source_id", "chunk_no", "chunk_id"), ["source_id", "chunk_no"])
    found = E.check_replies(replies)
    # the fake provider has nothing to say about a chunk that begins without a sentence; that is no failure
    return found.withColumn("status", F.when(F.lit(provider is None) & F.col("reply").isNull(), "none").otherwise(F.col("status")))


def _merge(concepts: DataFrame, names: DataFrame, heading_chunk: DataFrame) -> DataFrame:
    """One candidate for each identity of a source: the first title, role, definition; key points and evidence united."""
    c = concepts.where("status in ('ok', 'repaired')").select(
        "source_id", "chunk_no", "chunk_id", F.col("concept.title").alias("title"), F.col("concept.role").alias("role"),
        F.col("concept.definition").alias("definition"), F.col("concept.key_points").alias("points"), F.col("concept.evidence").alias("e"))
    c = A.promote(c, heading_chunk)
    cited = F.transform("e", lambda x: F.struct(
        F.col("chunk_no").alias("chunk_no"), F.col("chunk_id").alias("chunk"), x["claim"].alias("claim"), x["excerpt"].alias("excerpt")))
    first = lambda n: F.min_by(n, "chunk_no").alias(n)
    # a title without letters and digits names nothing
    named = c.withColumn("identity", X.identity(F.col("title"))).where("identity <> ''")
    merged = named.groupBy("source_id", "identity").agg(
        F.min("chunk_no").alias("first_no"), *[first(n) for n in ("title", "role", "definition")],
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "points"))), lambda x: x["points"]))).alias("points"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(cited)))).alias("evidence"))
    order = Window.partitionBy("source_id").orderBy("chunk_no", "identity")
    numbered = merged.withColumnRenamed("first_no", "chunk_no").withColumn("cand_id", F.row_number().over(order).cast("bigint"))
    return numbered.join(names, "source_id").withColumn("primary", F.array_contains("names", F.col("identity"))).withColumn("own", F.lit(False))


def _located(candidates: DataFrame, chunks: DataFrame, view: DataFrame) -> DataFrame:
    """(source_id, cand_id, claim, excerpt, start, end, located): evidence in the view, its own chunk first."""
    e = candidates.select("source_id", "cand_id", F.explode("evidence").alias("e")).select("source_id", "cand_id", "e.chunk_no", "e.claim", "e.excerpt")
    ranges = chunks.select("source_id", "chunk_no", F.col("start").alias("pref_start"), F.col("end").alias("pref_end"))
    found = locate(e.join(ranges, ["source_id", "chunk_no"], "left"), view.select("source_id", "content"))
    return found.withColumn("located", F.col("start").isNotNull())


def _curate(candidates: DataFrame, groups: DataFrame, curator: Callable[[DataFrame], DataFrame] | None, subsections: DataFrame) -> DataFrame:
    """``candidates`` with ``group``, ``triggers`` and ``selected``; ``curator`` only selects, one call for each source with a trigger.

    The default curator keeps the smallest of each duplicate group. ``curator`` gets (source_id, cand_id, title, role,
    triggers) and returns (source_id, title); a title that is no candidate's makes ``unknown`` true.
    """
    kept = A.keep_roles(candidates).join(groups, ["source_id", "cand_id"], "left")
    whole = Window.partitionBy("source_id")
    open_ = subsections.where(~F.col("covered")).select("source_id").distinct().withColumn("open", F.lit(True))
    why = F.array_compact(F.array(
        F.when(F.count(F.lit(1)).over(whole) > C.MAX_CONCEPTS, "too_many"), F.when(F.count("group").over(whole) > 0, "duplicate_risk"),
        F.when(F.avg(F.col("primary").cast("int")).over(whole) > C.DOMINANCE, "entity_dominance"), F.when(F.col("open"), "coverage")))
    x = kept.join(open_, "source_id", "left").withColumn("triggers", F.array_join(why, ","))
    if curator is None:
        return x.withColumn("selected", F.col("group").isNull() | (F.col("group") == F.col("cand_id"))).withColumn("unknown", F.lit(False))
    x = materialise(x, "curated")
    asked = x.where("triggers <> ''").select("source_id", "cand_id", "title", "role", "triggers")
    reply = materialise(curator(asked).select("source_id", X.identity(F.col("title")).alias("identity")).distinct(), "curator")
    bad = reply.join(x.where("triggers <> ''"), ["source_id", "identity"], "left_anti").select("source_id").distinct().withColumn("unknown", F.lit(True))
    hit = reply.withColumn("hit", F.lit(True))
    return x.join(hit, ["source_id", "identity"], "left").join(bad, "source_id", "left").withColumn(
        "selected", (F.col("triggers") == "") | F.coalesce("hit", F.lit(False))).withColumn("unknown", F.coalesce("unknown", F.lit(False))).drop("hit")


def scan(
    sources: DataFrame, provider: Callable[[str], str] | None = None, curator: Callable[[DataFrame], DataFrame] | None = None,
    notes: DataFrame | None = None, state: DataFrame | None = None, model: str = "fake", domain: str = "unsorted",
) -> Scan:
    """The plan of a run over ``sources`` (source_id, title, text).

    ``notes`` (path, title, origin, human_verified, body) are the notes there are, ``state`` (source_id, content_hash)
    the sources that were processed; unchanged ones cost nothing. Replies, views and what a later step
    reads twice are written once, so a model is asked once for each chunk. A source fails as a whole: a reply that is
    not valid (technical), an unknown title of the curator (technical) or a reason of the gate (quality) plans nothing
    for it, and the run's exit code tells a caller to write nothing at all. Null and empty texts, which have no view,
    give a report row and no notes.
    """
    rows = sources.select("source_id", "title", "text", X.sha256(F.coalesce("text", F.lit(""))).alias("content_hash"))
    if state is not None:
        rows = rows.join(state.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti")
    view = materialise(L.processing_view(rows.withColumn("chars", F.length(F.coalesce("text", F.lit(""))).cast("bigint"))), "view")
    cut = K.chunks(view, "source_id", "content", overlap=C.OVERLAP_CHARS)
    chunks = materialise(cut.withColumn("chunk_id", X.chunk_id(F.col("chunk_no"), F.col("text"))), "chunks")
    names = view.select("source_id", X.aliases(F.col("title")).alias("names"))
    parsed = materialise(H.parse(L.lines(view)), "parsed")
    subs = H.method_subsections(parsed)
    body = F.regexp_replace(F.expr('substr(content, start + 1, end - start)'), "^[^\n]*\n?", "")
    subs = materialise(subs.join(view.select("source_id", "content"), "source_id").withColumn("body", body).drop("content"), "subsections")
    heads = V.heading_chunks(subs.select("source_id", "sub_id", F.col("canonical").alias("heading")), chunks).select("source_id", "heading", "chunk_no")

    general = materialise(_concepts(chunks, provider), "general")
    first = materialise(_merge(general, names, heads), "candidates")
    evidence = materialise(_located(first, chunks, view), "evidence")
    targets = V.targets(V.uncovered(subs, first, evidence)).select(
        "source_id", (F.lit(TARGETED) + F.col("n")).cast("bigint").alias("chunk_no"), F.col("target_id").alias("chunk_id"),
        F.concat("heading", F.lit("\n"), F.left("body", F.lit(C.CHUNK_CHARS))).alias("text"), "start", "end")
    targets = materialise(targets, "targets")
    concepts, ranges = general, chunks.select("source_id", "chunk_no", "start", "end")
    if not targets.isEmpty():
        concepts = general.unionByName(materialise(_concepts(targets, provider), "targeted"))
        own = targets.join(subs.select("source_id", F.col("start"), F.col("canonical").alias("heading")), ["source_id", "start"]).select("source_id", "heading", "chunk_no")
        ranges = ranges.union(targets.select("source_id", "chunk_no", "start", "end"))
        first = materialise(_merge(concepts, names, heads.union(own)), "candidates")
        evidence = materialise(_located(first, ranges, view), "evidence")
    covered = V.title_cover(subs, first).union(V.evidence_cover(subs, first, evidence)).select("source_id", "sub_id").distinct().withColumn("covered", F.lit(True))
    asked = targets.select("source_id", F.col("start"), F.lit(True).alias("targeted"))
    subs = materialise(subs.join(covered, ["source_id", "sub_id"], "left").join(asked, ["source_id", "start"], "left").fillna(False, ["covered", "targeted"]), "covered")

    groups = A.duplicate_groups(first, F.col("names"))
    chosen = materialise(_curate(first, groups, curator, subs), "curated")
    gate = _gate(chosen, groups)
    report = _report(view, chunks, concepts, first, evidence, chosen, gate, subs)
    plan = _plan(chosen, report, view, notes, model, domain)
    return Scan(view, chunks, chosen, evidence, subs, gate, plan, report)


def _gate(chosen: DataFrame, groups: DataFrame) -> DataFrame:
    """The gate's reasons and ``too_many``: more candidates than allowed fail, they are never cut."""
    g = A.gate(chosen.drop("group"), groups)
    many = chosen.where("selected").groupBy("source_id").agg((F.count(F.lit(1)) > C.MAX_CONCEPTS).alias("many"))
    why = F.array_join(F.array_compact(F.array(F.nullif("reasons", F.lit("")), F.when(F.col("many"), "too_many"))), ",")
    return g.join(many, "source_id", "left").select("source_id", F.when(why == "", "pass").otherwise("failed").alias("status"), why.alias("reasons"))


def _report(
    view: DataFrame, chunks: DataFrame, concepts: DataFrame, candidates: DataFrame, evidence: DataFrame, chosen: DataFrame, gate: DataFrame, subs: DataFrame,
) -> DataFrame:
    """One row for each source: sizes, calls, coverage, locatability, gate, exit code."""
    size = chunks.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.round(F.avg(F.col("end") - F.col("start")), 1).alias("avg_chunk"), F.max(F.col("end") - F.col("start")).alias("max_chunk"))
    calls = concepts.groupBy("source_id").agg(
        F.count_if(F.col("chunk_no") > TARGETED).alias("recovery_calls"), F.count_if(F.col("status") == "repaired").alias("json_repairs"),
        F.count_if(F.col("failure") == "timeout").alias("timeouts"), F.count_if(F.col("status") == "failed").alias("failures"))
    cands = candidates.groupBy("source_id").agg(F.count(F.lit(1)).alias("candidates"))
    picked = chosen.groupBy("source_id").agg(
        F.count_if("selected").alias("selected"), F.max(F.when(F.col("triggers") != "", 1).otherwise(0)).alias("curator_calls"), F.bool_or("unknown").alias("unknown"))
    found = evidence.groupBy("source_id").agg(F.count_if("located").alias("located"), F.count(F.lit(1)).alias("excerpts"))
    cover = subs.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("detected"), F.count_if(F.col("covered") & ~F.col("targeted")).alias("covered_before"), F.count_if("targeted").alias("targeted"),
        F.count_if(F.col("covered") & F.col("targeted")).alias("recovered"), F.count_if(~F.col("covered")).alias("still_uncovered"))
    x = view.select("source_id", "content_hash", F.col("chars").alias("source_chars"), F.length("content").cast("bigint").alias("processing_chars"))
    for part in (size, calls, cands, picked, found, cover, gate.withColumnRenamed("status", "gate")):
        x = x.join(part, "source_id", "left")
    counts = ("chunks", "max_chunk", "recovery_calls", "json_repairs", "timeouts", "failures", "candidates", "selected", "curator_calls", "located", "excerpts",
              "detected", "covered_before", "targeted", "recovered", "still_uncovered")
    x = x.fillna(0, [*counts, "avg_chunk"]).fillna(False, ["unknown"]).fillna("", ["reasons"]).fillna("pass", ["gate"])
    code = A.exit_code(F.col("failures") + F.col("unknown").cast("int"), F.lit(False), F.col("gate") == "failed")
    calls_all = (F.col("chunks") + F.col("curator_calls") + F.col("recovery_calls")).cast("bigint")
    return materialise(x.withColumn("llm_calls", calls_all).withColumn("exit_code", code).drop("unknown").withColumn(
        "locatability", F.format_string("located %d/%d across %d candidates", "located", "excerpts", "candidates")), "report")


def note_path(identity: Column) -> Column:
    return F.concat(F.lit(C.WIKI_DIR + "/"), F.replace(identity, F.lit(" "), F.lit("-")), F.lit(".md"))


def _plan(chosen: DataFrame, report: DataFrame, view: DataFrame, notes: DataFrame | None, model: str, domain: str) -> DataFrame:
    """(source_id, cand_id, title, path, action, content, base, source_hash, version) of the selected candidates of sources that passed.

    A title of several sources is planned once, for the smallest source, with the sources of all and their evidence.
    Only notes to create or update have content; protected and unreadable ones stay as they are.
    """
    if notes is None:
        notes = view.sparkSession.createDataFrame([], "path string, title string, origin string, human_verified string, body string")
    good = report.where(F.col("exit_code") == 0).select("source_id", "content_hash")
    picked = chosen.where("selected").join(good, "source_id").join(view.select("source_id", F.col("title").alias("source")), "source_id")
    actions = N.actions(picked.select("source_id", "cand_id", "title"), notes).select("source_id", "cand_id", "action")
    known = notes.groupBy(X.identity(F.col("title")).alias("identity")).agg(
        F.lit(True).alias("known"), F.min_by("title", "path").alias("known_title"), F.min_by("body", "path").alias("base"), F.min("path").alias("held"))
    x = picked.join(actions, ["source_id", "cand_id"]).join(known, "identity", "left")
    shown = F.when(F.col("known"), X.wikilink(F.col("known_title"))).otherwise(F.concat("title", F.lit(" (suggested)")))
    others = x.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("cand_id", shown.alias("shown")))).alias("others"))
    x = x.join(others, "source_id")
    related = F.transform(F.filter("others", lambda o: o["cand_id"] != F.col("cand_id")), lambda o: o["shown"])
    cited = F.transform("evidence", lambda e: F.struct(e["claim"].alias("claim"), F.col("source").alias("source"), e["excerpt"].alias("excerpt"), e["chunk"].alias("chunk")))
    one = x.withColumn("cited", cited).withColumn("related", related)
    first = lambda c: F.min_by(c, "source_id").alias(c)
    merged = one.groupBy("identity").agg(
        F.min("source_id").alias("source_id"), *[first(c) for c in ("cand_id", "title", "definition", "content_hash", "action", "base", "held")],
        F.array_sort(F.collect_set("source")).alias("all_sources"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "points"))), lambda p: p["points"]))).alias("points"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "cited"))), lambda p: p["cited"]))).alias("cited"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "related"))), lambda p: p["related"]))).alias("related"))
    none = F.array().cast("array<string>")
    note = N.render(
        F.col("title"), F.array(F.lit(domain)), F.col("all_sources"), F.col("definition"), F.col("points"), F.col("related"), F.lit(model),
        core_idea=F.lit(""), mechanism=F.lit(""), evidence=F.col("cited"), questions=none)
    ours = F.col("action").isin("create", "update")
    return merged.select(
        "source_id", "cand_id", "title", F.coalesce("held", note_path(F.col("identity"))).alias("path"), "action", F.when(ours, note).alias("content"), "base",
        "all_sources",
        F.col("content_hash").alias("source_hash"), F.lit(C.VIEW_VERSION).alias("version"))
