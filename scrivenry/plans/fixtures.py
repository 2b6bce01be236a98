"""Invented literal fixtures, shared by a query and its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name: (columns, rows)
FIXTURES: dict[str, tuple[str, list[tuple]]] = {
    "titles": ("source_title string, title string", [
        ("Q-NET: Quiet Networks for Small Agents", "Q-NET Gate Folding Mechanism"),
        ("Q-NET: Quiet Networks for Small Agents", "Quiet Networks"),
        ("Q-NET: Quiet Networks for Small Agents", "The Gate-Folding Method"),
        ("Q-NET: Quiet Networks for Small Agents", "Folding Gate Process"),
        ("A-MEM: Agentic Memory for LLM Agents", "A-MEM Memory Evolution Mechanism"),
        ("A-MEM: Agentic Memory for LLM Agents", "Evolutionary Memory Update"),
        ("A-MEM: Agentic Memory for LLM Agents", "Memory Evolution Process"),
        ("A-MEM: Agentic Memory for LLM Agents", "Agentic Note Construction"),
        ("Plain Title", "System"),
        ("Plain Title", "An Approach System Framework"),
    ]),
    "lines": ("source_id bigint, ord bigint, line string", [
        (1, 1, "# Paper One"), (1, 2, "### Page 1"), (1, 3, "Opening words about k < n."), (1, 4, "## 3 Methodolodgy"),
        (1, 5, "### 3.1 Note Folding"), (1, 6, "Folding keeps the gate small."), (1, 7, "### Page 2"), (1, 8, "It goes on over the page."),
        (1, 9, "#### 3.1.1 Inner Step"), (1, 10, "The inner step."), (1, 11, "### 3.2 Link Finding"), (1, 12, "Links are found by size."),
        (1, 13, "### 3.3 Ablation Analysis"), (1, 14, "Nothing changes."), (1, 15, "### 3.4 Empty Part"), (1, 16, "## 4 Results"),
        (1, 17, "Numbers."), (1, 18, "## References"), (1, 19, "[1] Someone, somewhere."), (1, 20, "## Appendix A"), (1, 21, "Kept words."),
        (2, 1, "# Paper Two"), (2, 2, "### Page 1"), (2, 3, "## Contents"), (2, 4, "1 Intro ..... 2"), (2, 5, "## The Proposed Approach"),
        (2, 6, "### Gate"), (2, 7, "A gate opens."), (2, 8, "### Gate"), (2, 9, "A gate closes."), (2, 10, "## Related Method"), (2, 11, "Others."),
        (2, 12, "## Paper Checklist"), (2, 13, "Yes."), (2, 14, "## Model Architecture"), (2, 15, "Blocks."), (2, 16, "## 5 Framework"), (2, 17, "Not a root."),
    ]),
    "view_lines": ("id bigint, line string", [
        (1, "Figure 2: A gate."), (2, "Fig. 3 shows flow"), (3, "| a | b |"), (4, "|---|:-:|"), (5, "| 1.5 | 2.25 |"), (6, "| x | y | z"),
        (7, "x = a + b / c^2 = \\sum"), (8, "A plain sentence, kept."), (9, "0.1 0.2 0.3 0.4 0.5 0.6"), (10, "<<%%$$ ## ||"), (11, ""),
        (12, "> [... omitted from AI extraction: formula, PDF page 4]"), (13, "figure it out yourself"),
    ]),
    "candidates": ("source_id bigint, cand_id bigint, title string, role string, own boolean, primary boolean, selected boolean", [
        (1, 1, "Note Folding", "mechanism", True, False, True), (1, 2, "The Note-Folding Method", "component", True, False, False),
        (1, 3, "Q-NET", "method_entity", True, True, False), (1, 4, "Link Finding", "method_entity", True, False, True),
        (1, 5, "Big Baseline", "baseline", False, False, False), (1, 6, "Tiny Set", "dataset", True, False, False),
        (2, 1, "Gate", "mechanism", True, False, False), (2, 2, "Quiet Networks", "method_entity", True, True, True),
        (2, 3, "Q-NET System", "method_entity", True, True, True), (2, 4, "Other Set", "dataset", False, False, False),
        (3, 1, "Model", "concept", True, False, True), (4, 1, "Warm Start", "mechanism", True, False, True),
    ]),
    "evidence": ("source_id bigint, cand_id bigint, n bigint, start bigint, end bigint, located boolean", [
        (1, 1, 1, 120, 150, True), (1, 1, 2, 400, 420, True), (1, 2, 1, None, None, False), (1, 4, 1, 260, 280, True),
        (2, 1, 1, 90, 99, True), (2, 2, 1, None, None, False), (4, 1, 1, 5, 9, True), (4, 1, 2, None, None, False),
    ]),
    "subsections": ("source_id bigint, sub_id string, heading string, start bigint, end bigint, body string", [
        (1, "ms-aaaa0001", "note folding", 100, 200, "Folding keeps the gate small."), (1, "ms-aaaa0002", "link finding", 200, 300, "Links are found by size."),
        (1, "ms-aaaa0003", "empty part", 300, 310, "  "), (1, "ms-aaaa0004", "size rule", 310, 390, "Sizes rule."), (2, "ms-bbbb0001", "gate", 80, 160, "A gate opens."),
        (2, "ms-bbbb0002", "slow path", 160, 240, "Slow."),
    ] + [(5, f"ms-cccc{i:04d}", f"part {i}", 100 * i, 100 * i + 90, "Body.") for i in range(1, 12)]),
    "chunks": ("source_id bigint, chunk_no bigint, start bigint, end bigint, text string", [
        (1, 1, 0, 190, "Opening\n### 3.1 Note Folding\nFolding keeps"), (1, 2, 190, 320, "the gate small.\n### 3.2 Link Finding\nLinks"),
        (1, 3, 320, 400, "### 3.5 Size Rule\nSizes rule."), (2, 1, 0, 150, "### Gate\nA gate opens."), (2, 2, 150, 260, "and closes."),
    ]),
    "notes": ("path string, title string, origin string, type string, human_verified string, sources string, body string", [
        ("Library/Concepts/Note Folding.md", "Note Folding", "ai", "concept", "false", "[[S One]]", "Related to [[Gate]] and [[Missing Thing|it]]."),
        ("Library/Concepts/Gate.md", "Gate", "ai", "concept", "true", "[[S Two]]", "See [[Note Folding]]."),
        ("Library/Concepts/sub/Deep.md", "Deep", "ai", "concept", "false", "[[S Three]]", ""),
        ("Library/Knowledge/Warm Start.md", "Warm Start", "me", "concept", "false", "[[S One]]", ""),
        ("Library/Concepts/Model.md", "Model", "ai", "concept", "maybe", "[[S One]]", ""),
        ("Library/Concepts/Link Finding.md", "Link Finding", "ai", "concept", "false", "[[S One]]", ""),
        ("Library/Concepts/Link-finding.md", "Link-Finding", "ai", "concept", "false", "[[S Two]]", ""),
    ]),
    "sources": ("title string", [("S One",), ("S Two",)]),
    "frontmatter": ("id bigint, type string, origin string, knowledge_status string, domain string, created string, source_url string, source_file string, human_verified string", [
        (1, "source", "external", "raw", "machine-learning", "2026-01-02", "https://example.org/a", None, "false"),
        (2, "concept", "ai", "processed", "graph", "2026-02-30", None, None, "false"),
        (3, "concept", "ai", "understood", "graph", "2026-02-03", None, "a/b.pdf", "true"),
        (4, "novel", "me", "raw", "Bad Domain", "2026-02-03", "ftp://x", "/abs/b.pdf", "false"),
        (5, None, "external", "raw", "x", "", "http://example.org", "c.pdf", "no"),
    ]),
    "replies": ("id bigint, reply string", [
        (1, '{"title":"Gate","role":"mechanism","definition":"d","key_points":["k"],"evidence":[{"claim":"c","excerpt":"e"}]}'),
        (2, '```json\n{"title":"Gate","role":"mechanism","definition":"d","key_points":["k",],"evidence":[{"claim":"c","excerpt":"e"}],}\n```'),
        (3, '{"title":"Gate","role":"mecha'), (4, None), (5, '{"title":"Gate","role":"wizard","definition":"d","evidence":[{"claim":"c","excerpt":"e"}]}'),
        (6, '{"title":" ","role":"concept","definition":"d","evidence":[{"claim":"c","excerpt":"e"}]}'),
        (7, '{"title":"Gate","role":"concept","definition":"d","evidence":[]}'),
    ]),
    "curator": ("source_id bigint, title string", [(1, "Note Folding"), (1, "Link Finding"), (1, "New Idea"), (2, "Gate")]),
    "plans": ("plan_id bigint, digest string, found_digest string, version bigint, source_hash string, found_hash string, path string, action string, base string, found_base string, owner string, spent boolean", [
        (1, "d", "d", 6, "s", "s", "Library/Concepts/A.md", "create", None, None, None, False),
        (2, "d", "x", 6, "s", "s", "Library/Concepts/A.md", "create", None, None, None, False),
        (3, "d", "d", 5, "s", "s", "Library/Concepts/A.md", "create", None, None, None, False),
        (4, "d", "d", 6, "s", "t", "Library/Concepts/A.md", "create", None, None, None, False),
        (5, "d", "d", 6, "s", "s", "Library/Concepts/x/A.md", "create", None, None, None, False),
        (6, "d", "d", 6, "s", "s", "Library/Concepts/A.md", "create", None, "b", "ai", False),
        (7, "d", "d", 6, "s", "s", "Library/Concepts/A.md", "update", "b", "b", "ai", False),
        (8, "d", "d", 6, "s", "s", "Library/Concepts/A.md", "update", "b", "c", "ai", False),
        (9, "d", "d", 6, "s", "s", "Library/Concepts/A.md", "update", "b", "b", "me", False),
        (10, "d", "d", 6, "s", "s", "Library/Concepts/A.md", "create", None, None, None, True),
        (11, "d", "d", 6, "s", None, "Library/Concepts/A.md", "create", None, None, None, False),
    ]),
    "old_sources": ("source_id bigint, content string, extra string, highlights string, related string", [
        (1, "old one", "shelf=3", "my mark", "[[Gate]]"), (2, "same", "", "", ""), (4, "gone", "", "h", ""),
    ]),
    "new_sources": ("source_id bigint, content string, extra string", [(1, "new one", "shelf=9"), (2, "same", ""), (3, "fresh", "")]),
    "configs": ("id bigint, base_url string, keep_alive string", [
        (1, "http://localhost:11434", "30s"), (2, "https://127.0.0.1/api", "2m"), (3, "http://example.org", "3600"), (4, "http://[::1]:9", "61m"),
        (5, "http://localhost.evil.org", "1h"), (6, "http://user@127.0.0.1", "-1"), (7, "ftp://localhost", ""), (8, "http://127.0.0.1:80?x", "3601"), (9, "HTTP://LOCALHOST", "60m"),
    ]),
    "endpoints": ("id bigint, base_url string, proxy string, redirect string, model string, enabled boolean, llm_calls bigint, exit_code bigint", [
        (1, "http://localhost:11434", None, None, "small:4b", True, 14, 0), (2, "http://localhost:11434", "http://proxy:3128", None, "small:4b", True, 3, 5),
        (3, "http://127.0.0.1:1", "", "http://example.org/x", "small:4b", True, 0, 0), (4, "http://127.0.0.1:1", None, "http://localhost/x", "large:120b-cloud", False, 5, 0),
        (5, "http://example.org", "p", "http://example.org", "Large:CLOUD", True, 5, 4), (6, None, None, None, None, None, 5, 6), (7, "https://[::1]/", None, None, "m", True, 2, 6),
    ]),
    "proposals": ("id bigint, target string, change string, reason string, sources string, part string", [
        (1, "Knowledge/A.md", "add", "because", "[[S One]]", "Mechanism"), (2, "Knowledge/A.md", "add", None, "[[S One]]", "Mechanism"), (3, "", "add", "x", "[[S One]]", "P"),
    ]),
    "relations": ("id bigint, old_claim string, new_claim string", [
        (1, "Gates are small.", "gates are  small"), (2, "Gates are small.", "Gates are small and fast."), (3, "Gates are small.", "Gates are not small."),
        (4, "Gates are small.", "Links are large."),
    ]),
    "runs": ("source_id bigint, chunks bigint, curator bigint, recovery bigint, repairs bigint, timeouts bigint, failures bigint, low_text boolean, gate string", [
        (1, 13, 1, 3, 0, 0, 0, False, "pass"), (2, 13, 1, 0, 0, 0, 0, False, "pass"), (3, 4, 0, 0, 1, 0, 0, False, "failed"), (4, 6, 0, 0, 1, 1, 1, False, "pass"), (5, 0, 0, 0, 0, 0, 0, True, "pass"),
    ]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    columns, rows = FIXTURES[name]
    return spark.createDataFrame(rows, columns)


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return str(x)


def values(name: str) -> str:
    """``name AS (SELECT ... FROM (VALUES ...))`` for a WITH clause."""
    columns, rows = FIXTURES[name]
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN"}
    names = [c.split() for c in columns.split(", ")]
    listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    picked = ", ".join(f'CAST("{n}" AS {kinds[k]}) AS "{n}"' for n, k in names)
    return f'"{name}" AS (SELECT {picked} FROM (VALUES {listed}) AS v({", ".join(chr(34) + n + chr(34) for n, _ in names)}))'


def with_values(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(map(values, names))
