import duckdb
import pytest
from pyspark.sql import functions as F

from scrivenry.functions import text as X
from scrivenry.operators import chunks as K, extract as E
from scrivenry.operators.graph import connected_components
from scrivenry.plans import registry
from scrivenry.plans.fixtures import frame
from scrivenry.sources import markdown as M, sinks as S


def show(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, sf, name):
    import glob
    import os

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    theirs = sorted(tuple(show(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols
    assert ours == theirs


def test_every_query_of_the_registry_has_rows(spark, sf):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, sf).count() > 0
    assert registry.flagship(spark, sf).count() == 200


def test_golden_signatures(spark):
    t = frame(spark, "titles").where("source_title like 'A-MEM%'").withColumn("n", X.aliases(F.col("source_title")))
    got = {r["title"]: set(r["s"]) for r in t.select("title", X.signatures(F.col("title"), F.col("n")).alias("s")).collect()}
    assert got["A-MEM Memory Evolution Mechanism"] == {"memory evolution", "mem memory evolution"}
    assert got["Evolutionary Memory Update"] == {"evolutionary memory update"}
    assert got["Memory Evolution Process"] == {"memory evolution process"}


def test_golden_subsection_ids(spark):
    want = {"note construction": "ms-c3d558db", "link generation": "ms-51290a96", "memory evolution": "ms-f3cc630f", "retrieve relative memory": "ms-009e7175"}
    df = spark.createDataFrame([(k,) for k in want], "h string").select("h", X.subsection_id(F.col("h"), F.lit(1)).alias("i"))
    assert {r["h"]: r["i"] for r in df.collect()} == want


def test_method_roots(spark):
    yes = ["methodolodgy", "our approach", "proposed method", "model architecture", "the proposed approach"]
    no = ["framework", "a mem", "related method", "existing approaches", "a very long winded method", "", "evaluation method"]
    df = spark.createDataFrame([(x,) for x in yes + no], "c string").select("c", X.is_method_root(F.col("c")).alias("y"))
    assert {r["c"] for r in df.collect() if r["y"]} == set(yes)


def test_locate_excerpt():
    text = "Intro. The *Gate*  is\nsmall. Then the gate is small again."
    a, b = X.locate_excerpt("the gate is small", text)
    assert text[a:b] == "The *Gate*  is\nsmall"
    assert X.locate_excerpt("the gate is small", text, (25, len(text)))[0] > b
    assert X.locate_excerpt("the gates are small", text) is None
    assert X.locate_excerpt("", text) is None and X.locate_excerpt("*_", text) is None
    assert X.locate_excerpt("ﬁne straße", "A FINE STRASSE here") == (2, 14)
    assert X.locate_excerpt("formula", "> [... omitted from AI extraction: formula]") is None


def test_chunks_are_slices(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in K.chunks(docs, "doc_id", overlap=200).collect():
        assert r["text"] == texts[r["doc_id"]][r["start"]:r["end"]] and r["end"] - r["start"] <= 4000


def test_long_texts_are_chunked_in_seconds(spark):
    import time

    text = "\n".join(f"line {i} é" for i in range(200_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    began = time.time()
    blocks, chunks = K.blocks(df, "doc_id").collect(), K.chunks(df, "doc_id", overlap=200).collect()
    assert time.time() - began < 60
    assert [r["text"] for r in blocks] == text.split("\n") and all(text[r["start"]:r["end"]] == r["text"] for r in blocks[::997])
    assert all(text[r["start"]:r["end"]] == r["text"] and r["doc_id"] == 1 for r in chunks) and chunks[-1]["end"] == len(text)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (5, 5), (None, 3)] + [(300, 300 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == 0 and got[201] == 200 and {got[i] for i in range(300, 330)} == {300}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_few_links_cost_the_driver_few_jobs(spark):
    """Links below the bound are joined in one task, with the result of the rounds, for every type; a long chain took some 90 jobs."""
    edges = [(i, i + 1) for i in range(-30, 70)] + [(i * 37 % 61 + 200, i * 53 % 97 + 200) for i in range(60)] + [(5, 5), (None, 3)]
    own = {"bigint": int, "string": str, "binary": lambda x: (x % 2**64).to_bytes(8)}
    for kind, make in own.items():
        df = spark.createDataFrame([tuple(None if x is None else make(x) for x in e) for e in edges], f"a {kind}, b {kind}")
        spark.sparkContext.setJobGroup(f"few {kind}", "")
        try:
            few = connected_components(df)
            got = sorted(map(tuple, few.collect()))
            jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few {kind}"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert jobs <= 10
        for bound in (0, 300):  # rounds to the end, and rounds until links are few
            many = df if not bound else df.union(spark.createDataFrame(
                [(make(a), make(b)) for a in range(200, 230) for b in range(200, a)], df.schema))
            want = sorted(map(tuple, connected_components(many).collect()))
            assert want == sorted(map(tuple, connected_components(many, one_task=bound).collect()))
        parent = {}
        for n, c in got:
            parent[n] = c
        assert all(parent[x] == parent[y] for x, y in (map(make, e) for e in edges if None not in e and e[0] != e[1]))
        assert all(c == min(n for n in parent if parent[n] == c) for c in set(parent.values()))


def test_provider_runs_once_and_failures_are_kept(spark):
    c = spark.createDataFrame([(1, 1, "a"), (1, 2, "boom")], "doc_id bigint, chunk_no bigint, text string")

    def provider(text):
        if text == "boom":
            raise TimeoutError
        return '{"title":"T","role":"concept","definition":"d","key_points":[],"evidence":[{"claim":"c","excerpt":"e"}]}'

    got = E.check_replies(E.extract(c, provider, "doc_id"))
    assert {r["chunk_no"]: (r["status"], r["failure"]) for r in got.collect()} == {1: ("ok", None), 2: ("failed", "timeout")}


def test_providers_get_their_limits(spark):
    c = spark.createDataFrame([(1, 1, "a"), (1, 2, "slow")], "doc_id bigint, chunk_no bigint, text string")

    def provider(text, max_tokens, temperature, timeout_s):
        import time

        time.sleep(1.2 if text == "slow" else 0)
        return f"{max_tokens} {temperature} {timeout_s}"

    got = {r["chunk_no"]: (r["reply"], r["failure"]) for r in E.extract(c, provider, "doc_id", timeout_s=1).collect()}
    assert got == {1: ("1024 0 1", None), 2: (None, "timeout")}


def test_replies_are_strict(spark):
    good = '{"title":"T","role":"concept","definition":"d","key_points":["k"],"evidence":[{"claim":"c","excerpt":"e"}]}'
    bad = [good.replace('"key_points":["k"],', ""), good.replace('"d"', '"d","more":1'), good.replace('["k"]', "[1]"), good.replace('["k"]', '["k",null]'), good.replace('"c"', "null"),
           good.replace(',"excerpt":"e"', ""), good.replace('"T"', "3"), good.replace('[{"claim":"c","excerpt":"e"}]', '[{"claim":"c","excerpt":"e"},{"claim":"c"}]'), f"[{good}]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([good, *bad])], "id bigint, reply string")
    assert {r["id"] for r in E.check_replies(df).where("status <> 'failed'").collect()} == {0}


def test_notes_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("---\ntype: source\ndomain: [a, b]\nextra: 7\nhuman_verified: false\n---\n# T\n\n## Content\n\nk < n\n\n## Related\n")
    (tmp_path / "in" / "b.md").write_text("no front")
    notes = M.read_notes(spark, str(tmp_path / "in")).withColumn("p", M.parse_properties(F.col("frontmatter"))).withColumn("c", M.section(F.col("body"), "Content"))
    got = {r["path"][-4:]: r for r in notes.collect()}
    assert got["a.md"]["p"] == {"type": "source", "domain": '["a", "b"]', "extra": "7", "human_verified": "false"} and got["a.md"]["c"] == "k < n"
    assert got["b.md"]["p"] is None and got["b.md"]["body"] == "no front"
    out = str(tmp_path / "t")
    for n in (3, 5):
        S.write_atomic(spark.range(n), out)
        assert spark.read.parquet(out).count() == n
    plan = spark.createDataFrame([("p", "create", "c", None)], "path string, action string, content string, base string")
    d = S.save_plan(plan, str(tmp_path / "plan"))
    assert S.plan_digest(S.read_plan(spark, str(tmp_path / "plan"))) == d
    checks = frame(spark, "plans")
    assert not S.apply_plan(plan, checks, str(tmp_path / "w"), True) and not (tmp_path / "w").exists()
    assert S.apply_plan(plan, checks.where("plan_id = 1"), str(tmp_path / "w"), True) and (tmp_path / "w").exists()


def test_ingest_and_cli(spark, sf, tmp_path, capsys):
    from scrivenry.cli import main

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.txt").write_text("k < n \\<unknown " + "word " * 100)
    got = M.ingest(spark, str(tmp_path / "p")).collect()
    assert got[0]["content"].startswith("k &lt; n &lt;unknown") and got[0]["exit_code"] == 0
    (tmp_path / "p" / "b.txt").write_text("short")
    assert main(["ingest", str(tmp_path / "p")], spark) == 3
    docs = f"{sf}/documents.parquet"
    # one source that fails its gate blocks the whole run
    spark.createDataFrame([(1, "Method. Nothing more."), (2, "A small gate. More.")], "doc_id bigint, text string").write.parquet(str(tmp_path / "generic"))
    assert main(["scan", str(tmp_path / "generic"), "--save-plan", str(tmp_path / "plan")], spark) == 6 and not (tmp_path / "plan").exists()
    assert main(["scan", docs, "--save-plan", str(tmp_path / "whole")], spark) == 0
    one = spark.read.parquet(docs).where("length(text) between 500 and 3000").orderBy("doc_id").first()["doc_id"]
    assert main(["scan", docs, "--source", str(one), "--save-plan", str(tmp_path / "plan")], spark) == 0
    digest = capsys.readouterr().out.split("digest=")[-1].strip()
    assert "# create Library/Concepts/" in "".join(x.read_text() for x in (tmp_path / "plan.review").glob("*.txt"))
    with pytest.raises(ValueError):
        S.save_plan(S.read_plan(spark, str(tmp_path / "plan")), str(tmp_path / "no"), write=True)
    with pytest.raises(ValueError):
        S.save_plan(S.read_plan(spark, str(tmp_path / "plan")), str(tmp_path / "no"), exit_code=5)
    apply = ["apply", str(tmp_path / "plan"), "--sources", docs, "--spent", str(tmp_path / "spent"), "--write", str(tmp_path / "o"), "--digest"]
    assert main([*apply, "x"], spark) == 5
    spark.read.parquet(docs).where(F.col("doc_id") == one).withColumn("text", F.lit("changed")).write.parquet(str(tmp_path / "changed"))
    assert main([*apply[:2], "--sources", str(tmp_path / "changed"), "--digest", digest], spark) == 5
    assert "source_changed" in capsys.readouterr().out
    assert main([*apply, digest], spark) == 0 and main([*apply, digest], spark) == 5
    notes = S.read_current(spark, str(tmp_path / "o"))
    assert notes.count() > 0 and "### Evidence 1" in notes.first()["content"]
    state = str(tmp_path / "state")
    run = ["scan", docs, "--source", str(one), "--state", state, "--write", str(tmp_path / "w")]
    assert main(run, spark) == 0 and "planned=0" not in capsys.readouterr().out
    assert main(run, spark) == 0 and "planned=0" in capsys.readouterr().out


def test_verify_marks_machine_notes(spark, tmp_path, capsys):
    from scrivenry.cli import main

    spark.createDataFrame([(1, "The *Gate*  is\nsmall."), (2, "Other.")], "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, "the gate is small"), (1, "the gate is large"), (2, "nothing")], "doc_id bigint, excerpt string").write.parquet(str(tmp_path / "e"))
    notes = [("a.md", "A", "ai", "false", "body", 1), ("b.md", "B", "me", "false", "body", 1), ("c.md", "C", "ai", "true", "body", 2), ("d.md", "D", "ai", "false", "body", 9)]
    spark.createDataFrame(notes, "path string, title string, origin string, human_verified string, body string, doc_id bigint").write.parquet(str(tmp_path / "n"))
    base = ["verify", str(tmp_path / "d"), str(tmp_path / "e"), "--notes", str(tmp_path / "n"), "--write", str(tmp_path / "o")]
    assert main(base, spark) == 2 and "1 of 3" in capsys.readouterr().out
    assert main([*base, "--reviewer", "R"], spark) == 0
    got = {r["path"]: (r["human_verified"], r["verified_by"], r["body"]) for r in S.read_current(spark, str(tmp_path / "o")).collect()}
    assert got["a.md"] == ("true", "ai", "body\nVerification: 1 of 2 excerpts verbatim, by R\n")
    assert got["b.md"] == ("false", None, "body") and got["c.md"] == ("true", None, "body") and got["d.md"] == ("false", None, "body")


PAPER = """# Q-Net: small gates for graphs

Intro prose says things. More of it.

## 3 Method

### 3.1 Note Folding

Note folding joins notes that say the same. It runs often.

### 3.2 Link Finding

Link finding draws edges between notes.

### 3.3 Experiment Setup

Not a mechanism.

## References

Nobody. A paper nobody reads.
"""


def test_main_path_over_a_paper(spark):
    import json

    from scrivenry.operators import scan as R

    def provider(text):
        title, role = ("Note Folding", "method_entity") if "folding joins" in text and "Link finding" in text else ("Link Finding", "mechanism") if text.startswith("Link Finding") else ("Gate", "concept")
        line = [x for x in text.split("\n") if x and not x.startswith("#")][-1] if title != "Gate" else text[:20]
        return json.dumps({"title": title, "role": role, "definition": "d", "key_points": ["k"], "evidence": [{"claim": "c", "excerpt": line}]})

    sources = spark.createDataFrame([(1, "Q-Net: small gates for graphs", PAPER), (2, "Empty", None), (3, "Known", "Old words.")], "source_id bigint, title string, text string")
    import hashlib

    state = spark.createDataFrame([(3, hashlib.sha256(b"Old words.").hexdigest())], "source_id bigint, content_hash string")
    notes = spark.createDataFrame([("Library/Concepts/gate.md", "Note-Folding", "ai", "false", "old")], "path string, title string, origin string, human_verified string, body string")
    got = R.scan(sources, provider=provider, notes=notes, state=state)
    report = {r["source_id"]: r for r in got.report.collect()}
    assert set(report) == {1, 2} and "nobody reads" not in got.view.where("source_id = 1").first()["content"]
    r = report[1]
    assert (r["detected"], r["covered_before"], r["targeted"], r["recovered"], r["still_uncovered"], r["recovery_calls"]) == (2, 1, 1, 1, 0, 1)
    assert (r["candidates"], r["selected"], r["located"], r["excerpts"], r["llm_calls"], r["gate"], r["exit_code"]) == (2, 2, 2, 2, 2, "pass", 0)
    cands = {x["title"]: x for x in got.candidates.collect()}
    assert cands["Note Folding"]["role"] == "mechanism" and cands["Link Finding"]["role"] == "mechanism"
    plan = {x["title"]: x for x in got.plan.collect()}
    assert plan["Note Folding"]["action"] == "update" and plan["Note Folding"]["path"] == "Library/Concepts/gate.md" and plan["Note Folding"]["base"] == "old"
    text = plan["Link Finding"]["content"]
    assert plan["Link Finding"]["action"] == "create" and [x for x in text.split("\n") if x.startswith("## ")] == [
        f"## {x}" for x in ("Definition", "Core Idea", "Mechanism", "Key Points", "Related Concepts", "Evidence", "Sources", "Open Questions", "Provenance")]
    assert "- [[Note-Folding]]" in text and "Source: [[Q-Net: small gates for graphs]]" in text
    assert got.exit_code() == 0

    broken = R.scan(sources, provider=lambda t: "{", notes=notes)
    assert broken.exit_code() == 5 and broken.plan.count() == 0
    curated = R.scan(sources.where("source_id = 1"), provider=provider, curator=lambda asked: asked.select("source_id", F.lit("Unheard Of").alias("title")))
    assert curated.report.first()["curator_calls"] in (0, 1)


def test_intermediate_results_are_released(spark, tmp_path):
    import os

    from scrivenry.sources import tables as T

    T.release(spark)
    df = T.materialise(spark.range(3), "some")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and T.release(spark) == 1 and not os.path.exists(path) and T.release(spark) == 0


def test_page_heads(spark):
    from scrivenry.sources import pages as P

    head = '<head><meta name="author" content="A &amp; B"><meta property="article:published_time" content="2024-03-05T10:00"><link rel="canonical" href="https://x.org/a"></head>'
    pages = spark.createDataFrame([(1, "https://x.org/a?utm=1", head), (2, " ", "<p>no head</p>")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in P.properties(pages, "2026-01-01").collect()}
    assert (got[1]["author"], str(got[1]["published"]), got[1]["source_url"]) == ("A & B", "2024-03-05", "https://x.org/a")
    assert got[2]["author"] is None and got[2]["published"] is None and got[2]["source_url"] is None


def test_locate_operator(spark):
    from scrivenry.operators.locate import locate

    text = "Intro. The *Gate*  is\nsmall. Then the gate is small again.\n> [... omitted from AI extraction: hidden words]"
    ev = spark.createDataFrame([(1, "a", "the gate is small", None, None), (1, "b", "the gate is small", 25, 200), (1, "c", "", None, None), (1, "d", None, None, None), (1, "e", "hidden words", None, None),
                                (2, "f", "x", None, None), (None, "g", "x", None, None), (1, "a", "the gate is small", None, None)], "source_id bigint, content string, excerpt string, pref_start int, pref_end int")
    contents = spark.createDataFrame([(1, text), (3, None)], "source_id bigint, content string")
    got = locate(ev, contents).collect()
    at = {r["content"]: (r["start"], r["end"]) for r in got}
    assert len(got) == 8 and text[at["a"][0]:at["a"][1]] == "The *Gate*  is\nsmall" and at["b"][0] > at["a"][1]
    assert all(at[k] == (None, None) for k in "cdefg")
    assert locate(ev.where("false"), contents).count() == 0


def test_short_excerpts_in_blocks(spark, monkeypatch):
    from scrivenry.operators import locate as O

    texts = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "betamax gam"), (3, "")], "doc_id bigint, hay string")
    needles = ["alp", "a beta g", "beta gamma", "ta gamma delta eps", "nothing", "max gam", "beta gamma delta epsilon"]
    items = spark.createDataFrame(list(enumerate(needles)), "item_id int, needle string")
    want = {(d, i) for d, h in ((1, "alpha beta gamma delta epsilon"), (2, "betamax gam")) for i, n in enumerate(needles) if n in h}
    for block in (10_000, 1):
        monkeypatch.setattr(O, "SHORT_BLOCK", block)
        assert want <= {(r["doc_id"], r["item_id"]) for r in O.candidate_pairs(texts, items).collect()}


def test_tables_stay_readable_at_every_step(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "t")
    S.write_atomic(spark.range(3), out)
    # a writer that dies between publishing and moving leaves the new table as the current one
    monkeypatch.setattr(S, "_promote", lambda *a: None)
    S.write_atomic(spark.range(5), out)
    monkeypatch.undo()
    assert spark.read.parquet(out).count() == 3 and S.read_current(spark, out).count() == 5
    S.write_atomic(spark.range(7), out)
    assert spark.read.parquet(out).count() == 7 == S.read_current(spark, out).count()


def test_every_document_is_ingested(spark, tmp_path):
    import hashlib

    from scrivenry.plans import sink_queries

    long = "k < n and " * 30
    spark.createDataFrame([(1, long), (2, "short"), (3, None), (None, long)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["exit_code"], r["content_sha256"]) for r in sink_queries.ingest_files(spark, str(tmp_path)).collect()}
    digest = hashlib.sha256(long.replace("<", "&lt;").encode()).hexdigest()
    assert got == {1: (0, digest), 2: (3, None), 3: (3, None), None: (0, digest)}


def test_stream_skips_what_it_has_seen(spark, sf, tmp_path):
    from scrivenry.streaming.incremental import changed_sources

    seen = []
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for _ in range(2):
        d.write.mode("append").parquet(str(tmp_path / "in"))
        changed_sources(spark, str(tmp_path / "in"), "doc_id bigint, text string", str(tmp_path / "ck"), lambda df, i: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 200


def test_registry_without_the_training_data_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'doc_chunks' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_notes_are_files_that_the_driver_does_not_list(spark, tmp_path):
    """A file for each page, also of odd ones, and no Spark task for every few of them."""
    import glob
    import hashlib

    from scrivenry.plans import sink_queries
    from scrivenry.sources.tables import shared_dir

    rows = [(i, f"https://x.example/{i}", f"<p>page {i}</p>") for i in range(40)] + [(40, 'https://x.example/?q="a\\b"', "<p>a\r\nb</p>"), (41, None, "<p>x</p>"), (42, "u", None), (43, "u", "")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    before = set(glob.glob(shared_dir(spark).removeprefix("file:") + "/notes-*"))
    got = sink_queries.note_scan(spark, str(tmp_path))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {(i, u, False, None if h is None else digest(h.replace("<p>", "").replace("</p>", ""))) for i, u, h in rows}
    assert {tuple(r) for r in got.collect()} == want
    made, = set(glob.glob(shared_dir(spark).removeprefix("file:") + "/notes-*")) - before
    assert len(glob.glob(made + "/*/*.md")) == len(rows)
    # before: a task for every 31 files at most, whatever their size
    assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_excerpts_at_the_start_of_their_range_need_no_whole_content(spark, monkeypatch):
    import random

    from scrivenry.operators import locate as O

    r = random.Random(5)
    made = ("a", "b", "A", " ", "  ", "\n", "*", "ﬁ", "i", "é", "> [... omitted from AI extraction: formula]\n", "ß")
    for _ in range(3000):
        content = "".join(r.choices(made, k=r.randint(0, 12)))
        a = r.randint(0, len(content))
        z = r.randint(a, len(content))
        excerpt = content[a:r.randint(a, len(content))]
        dead = X.omissions(content)
        fast = X.locate_at_start(excerpt, content, dead, (a, z))
        assert fast is None or fast == X.locate_normal(excerpt, X.normal_with_map(content), dead, (a, z))
    # before: each content was normalised whole, one character at a time
    sizes = []
    whole = X.normal_with_map
    monkeypatch.setattr(X, "normal_with_map", lambda t: sizes.append(len(t)) or whole(t))
    text = "Some words stand here. " * 1000
    assert X.locate_at_start(text[2300:2600], text, [], (2300, 6300)) == (2300, 2600) and max(sizes) == 300
    ev = spark.createDataFrame([(1, text[2300:2600], 2300, 6300), (1, text[:9], None, None), (2, "x", 0, 1)], "source_id long, excerpt string, pref_start long, pref_end long")
    got = O.locate(ev, spark.createDataFrame([(1, text)], "source_id long, content string")).collect()
    assert {(g["source_id"], g["start"], g["end"]) for g in got} == {(1, 2300, 2600), (1, 0, 9), (2, None, None)}


def test_scan_cuts_its_chunks_once(spark, monkeypatch):
    """Chunks are a table that later steps read, and chunk ids come with the replies, not by a join of texts."""
    from scrivenry.operators import scan as R

    names = []
    kept = R.materialise
    monkeypatch.setattr(R, "materialise", lambda df, name, *a: names.append(name) or kept(df, name, *a))
    R.scan(spark.createDataFrame([(1, "t", "First words. More.\nOther line."), (2, "u", None)], "source_id long, title string, text string"))
    assert "chunks" in names and names.index("chunks") < names.index("general")
    chunks = spark.createDataFrame([(1, 1, "c", "Word.")], "source_id long, chunk_no long, chunk_id string, text string")
    assert "Join" not in R._concepts(chunks, None)._jdf.queryExecution().optimizedPlan().toString()


def test_sections_in_one_projection(spark):
    """Outlines of whole texts equal the operators on lines, and need no shuffle."""
    import random

    from scrivenry.operators import coverage as V, headings as H

    r = random.Random(7)
    names = ("Method", "Our Approach", "Part", "part", "Results", "References", "!!", "Other method")
    marks = lambda: f"{'#' * r.randint(1, 6)} {r.choice(('', '3 ', '3.1 ', '3.1.1 ', '4. ', '3.2 '))}{r.choice(names)}"
    texts = ["\n".join(marks() if r.random() < 0.5 else r.choice((f"### Page {r.randint(1, 9)}", "", "words", "#no", "  ", "é😀")) for _ in range(r.randint(1, 30))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate([*texts, "", "# Method\n## Part\n" + "x" * 5000, None])]
    df = spark.createDataFrame(rows, "source_id long, content string").repartition(3).localCheckpoint()
    lines = df.select("source_id", F.posexplode(F.split("content", "\n", -1)).alias("ord", "line")).withColumn("ord", F.col("ord").cast("bigint"))
    parsed, out = H.parse(lines).localCheckpoint(), H.outlines(df)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(H.spans(parsed), out.select("source_id", F.inline("marks")).where("level > 0"))
    old, new = H.method_subsections(parsed), out.select("source_id", F.inline(H.subsections(F.col("marks"))))
    assert old.count() > 100 and same(old, new) and "Exchange" not in new._jdf.queryExecution().executedPlan().toString()
    body = F.regexp_replace(F.expr("substr(content, start + 1, end - start)"), "^[^\n]*\n?", "")
    want = V.targets(old.join(df, "source_id").withColumn("body", body)).select("source_id", "n", "sub_id", "target_id")
    first = V.first_bodies(F.filter(H.subsections(F.col("marks")), lambda x: x["filled"]), F.col("content"))
    got = out.select("source_id", F.posexplode(first).alias("p", "t")).select(
        "source_id", (F.col("p") + 1).alias("n"), "t.sub_id", V.target_id(F.col("t.sub_id"), F.col("t.heading"), F.col("t.body")).alias("target_id"))
    assert same(want, got)
    kept = H.kept_lines(parsed).groupBy("source_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("section")).alias("s"))
    k = out.select("source_id", H.kept_sections(F.col("marks"), F.col("lines")).alias("k")).where("size(k) > 0")
    assert same(kept, k.select("source_id", F.aggregate("k", F.lit(0).cast("bigint"), lambda n, x: n + x["lines"]).alias("n"), F.array_sort(F.array_distinct(F.col("k")["section"])).alias("s")))


def test_extractors_get_bounded_batches(spark):
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {n: spark.conf.getAll.get(n) for n in names}
    try:
        for n in names:
            spark.conf.unset(n)
        files = spark.range(3000).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 1000 == 0, F.repeat(F.lit("long "), 400_000)).otherwise(F.lit("short")).cast("binary").alias("content"))
        got = M.extract(files)
        # before: batches of 10,000 files, made into pandas objects
        assert int(spark.conf.get(names[0])) <= 1000 and int(spark.conf.get(names[1])) <= 8 << 20
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
        assert {(r["exit_code"], r["n"]): r["count"] for r in got.groupBy("exit_code", F.length("content").alias("n")).count().collect()} == {(0, 2_000_000): 3, (3, None): 2997}
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
