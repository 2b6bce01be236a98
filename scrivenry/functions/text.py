"""Scalar text functions as column builders; no Python runs on the executors except in ``nfkc``."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

from scrivenry import config as C

_EMPTY = "array<string>"


def escape_angle(text: Column) -> Column:
    """Restore ``\\<`` and ``\\>``, then encode both brackets."""
    plain = F.replace(F.replace(text, F.lit("\\<"), F.lit("<")), F.lit("\\>"), F.lit(">"))
    return F.replace(F.replace(plain, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def identity(text: Column) -> Column:
    """Lower case, everything but letters and digits to one blank, one leading article off.

    SQL has no Unicode normalisation; ``identity(nfkc(text))`` is the full rule.
    """
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(words, "^(a|an|the) ", "")


def strip_wrappers(ident: Column) -> Column:
    """Drop trailing wrapper words, repeatedly; a title of wrappers alone keeps its first word."""
    return F.regexp_replace(ident, "( (" + "|".join(C.WRAPPERS) + "))+$", "")


def aliases(title: Column) -> Column:
    """Identities that name a Source: of the whole title, of what stands before its colon, and the
    phrase after it up to ``for``, ``in`` or ``with``."""
    head = F.trim(F.substring_index(title, ":", 1))
    tail = F.when(F.instr(title, ":") > 0, F.trim(F.substr(title, F.instr(title, ":") + 1)))
    phrase = F.regexp_extract(identity(tail), r"^(.*?)( (?:for|in|with|of|via) .*)?$", 1)
    return F.array_distinct(F.filter(
        F.array(identity(title), identity(head), phrase), lambda x: x.isNotNull() & (x != "")))


def signatures(title: Column, names: Column) -> Column:
    """Wrapper-stripped identity with and without a leading alias; sorted, without blanks."""
    whole = identity(title)
    bare = F.transform(
        F.filter(names, lambda a: F.startswith(whole, F.concat(a, F.lit(" ")))),
        lambda a: F.substr(whole, F.length(a) + 2),
    )
    every = F.transform(F.concat(F.array(whole), bare), lambda x: strip_wrappers(x))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x != "")))


def normal_excerpt(text: Column) -> Column:
    """Lower case, emphasis marks off, white space collapsed: the part of the rule that SQL has.

    :func:`nfkc` adds compatibility forms and true case folding.
    """
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[*_`]", ""), r"[ \t\n\r\f]+", " "))


@lru_cache(1 << 16)
def _form(c: str) -> str:
    """NFKC and case folding of one character."""
    return unicodedata.normalize("NFKC", c).casefold()


def normal_with_map(text: str) -> tuple[str, list[int]]:
    """Full normalisation of one text: NFKC, case folding, marks off, blanks collapsed; with the
    original offset of every character that stays and the end as a last entry."""
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        for x in _form(c):
            if x in "*_`":
                continue
            if x.isspace():
                if out and out[-1] != " ":
                    out.append(" ")
                    at.append(i)
                continue
            out.append(x)
            at.append(i)
    while out and out[-1] == " ":
        out.pop()
        at.pop()
    at.append(at[-1] + 1 if at else 0)
    return "".join(out), at


def omissions(content: str) -> list[tuple[int, int]]:
    """Spans of the lines that stand for what was left out."""
    dead, pos = [], content.find(C.OMISSION)
    while pos >= 0:
        end = content.find("\n", pos)
        dead.append((pos, len(content) if end < 0 else end))
        pos = content.find(C.OMISSION, pos + 1)
    return dead


def locate_normal(
    excerpt: str | None, hay: tuple[str, list[int]] | None, dead: list[tuple[int, int]], preferred: tuple[int, int] | None,
) -> tuple[int, int] | None:
    """``locate_excerpt`` in a content that is normalised already."""
    if not excerpt or not hay:
        return None
    needle, _ = normal_with_map(excerpt)
    if not needle:
        return None
    text, at = hay
    first = None
    i = text.find(needle)
    while i >= 0:
        start, end = at[i], at[i + len(needle) - 1] + 1
        if not any(a <= start and end <= b for a, b in dead):
            if preferred is None or preferred[0] <= start and end <= preferred[1]:
                return start, end
            first = first or (start, end)
        i = text.find(needle, i + 1)
    return first


def locate_at_start(
    excerpt: str | None, content: str | None, dead: list[tuple[int, int]], preferred: tuple[int, int] | None,
) -> tuple[int, int] | None:
    """What ``locate_normal`` finds where the excerpt itself stands at the start of its preferred range, else None.

    No hit inside the range can begin before the first character of the excerpt that stays, so only the
    excerpt is normalised.
    """
    if not excerpt or not content or preferred is None:
        return None
    a, z = preferred
    if a < 0 or a + len(excerpt) > z or not content.startswith(excerpt, a):
        return None
    needle, at = normal_with_map(excerpt)
    if not needle:
        return None
    start, end = a + at[0], a + at[len(needle) - 1] + 1
    return None if any(x <= start and end <= y for x, y in dead) else (start, end)


def locate_excerpt(excerpt: str | None, content: str | None, preferred: tuple[int, int] | None = None):
    """(start, end) of the excerpt in the original content or None; a hit inside ``preferred`` wins,
    else the first. Only exact hits of normalised text count; hits inside an omission marker do not."""
    if not content:
        return None
    return locate_normal(excerpt, normal_with_map(content), omissions(content), preferred)


def nfkc(text: Column) -> Column:
    """NFKC and case folding, which Spark lacks, in Arrow batches."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    return run(text)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def subsection_id(heading: Column, occurrence: Column) -> Column:
    return F.concat(F.lit("ms-"), F.left(sha256(F.concat(heading, F.lit("\n"), occurrence.cast("string"))), F.lit(8)))


def chunk_id(number: Column, text: Column) -> Column:
    return F.concat(F.lit("chunk-"), F.lpad(number.cast("string"), 4, "0"), F.lit("-"), F.left(sha256(text), F.lit(16)))


def targeted_id(subsection: Column, text: Column) -> Column:
    return F.concat(F.lit("subsection-"), F.substr(subsection, F.lit(4)), F.lit("-"), F.left(sha256(text), F.lit(16)))


def wikilink(title: Column) -> Column:
    return F.concat(F.lit("[["), title, F.lit("]]"))


def link_targets(text: Column) -> Column:
    """Targets of ``[[target]]`` and ``[[target|shown]]`` in order."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]\[|]+)(?:\|[^\]\[]*)?\]\]"), F.lit(1))


def heading_parts(line: Column) -> dict[str, Column]:
    """Markdown level (0: none), section number, text and canonical form of a heading line."""
    level = F.length(F.regexp_extract(line, r"^(#{1,6}) ", 1))
    rest = F.regexp_replace(F.trim(F.regexp_replace(line, r"^#{1,6} +", "")), r"[*_`]", "")
    number = F.regexp_extract(rest, r"^([0-9]+(?:\.[0-9]+)*)\.? ", 1)
    text = F.trim(F.regexp_replace(rest, r"^[0-9]+(\.[0-9]+)*\.? ", ""))
    return {
        "level": level, "number": number, "text": text,
        "canonical": F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")),
        "depth": F.when(number == "", F.lit(0)).otherwise(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1),
    }


def close_to(word: Column, name: str) -> Column:
    """Equal, or within two edits where the name has six letters or more."""
    if len(name) < 6:
        return word == name
    return F.levenshtein(word, F.lit(name)) <= 2


def is_method_root(canonical: Column) -> Column:
    """Last word names a method (typos allowed), at most two words before it, none of them excluded."""
    words = F.split(canonical, " ")
    last = F.element_at(words, -1)
    named = None
    for name in C.ROOT_WORDS:
        named = close_to(last, name) if named is None else named | close_to(last, name)
    barred = F.exists(words, lambda w: F.regexp_like(w, F.lit("^(" + "|".join(C.ROOT_EXCLUDED) + ")")))
    return (F.length(canonical) > 0) & named & (F.size(words) <= 3) & ~barred


def is_excluded_subsection(canonical: Column) -> Column:
    return F.regexp_like(canonical, F.lit("(^| )(" + "|".join(C.SUBSECTION_EXCLUDED) + ")"))


def keep_alive_seconds(raw: Column) -> Column:
    """``N`` or ``Ns`` seconds or ``Nm`` minutes up to an hour; anything else null."""
    n = F.regexp_extract(raw, "^([0-9]{1,6})(s|m)?$", 1)
    unit = F.regexp_extract(raw, "^([0-9]{1,6})(s|m)?$", 2)
    value = F.when(n != "", n.cast("int") * F.when(unit == "m", 60).otherwise(1))
    return F.when(value <= C.KEEP_ALIVE_MAX_S, value)


def is_loopback(url: Column) -> Column:
    """Only plain http(s) to this machine."""
    host = F.regexp_extract(F.lower(url), r"^https?://(\[[0-9a-f:]+\]|[^/:@?#\[\]]+)(:[0-9]+)?([/?#]|$)", 1)
    return host.isin(*C.LOOPBACK)


def endpoint_reasons(url: Column, proxy: Column, redirect: Column, model: Column) -> Column:
    """Why a model connection is refused, joined by commas; empty where it is allowed. There is no fallback.

    Only this machine is talked to, directly: no remote host, no proxy, no redirect to elsewhere, no model that the
    server itself fetches from a cloud (``-cloud`` in its tag).
    """
    return F.array_join(F.array_compact(F.array(
        F.when(~F.coalesce(is_loopback(url), F.lit(False)), "remote_host"), F.when(F.coalesce(proxy, F.lit("")) != "", "proxy"),
        F.when(redirect.isNotNull() & ~is_loopback(redirect), "redirect"), F.when(F.lower(model).rlike("[:-]cloud$"), "cloud_model"))), ",")


def unload_requests(enabled: Column, llm_calls: Column, exit_code: Column) -> Column:
    """One request to unload the model at the end of a run, where it is enabled, a call was made and the run ended
    well or was blocked (exit 0, 5, 6); it is no model call."""
    asked = enabled & (llm_calls > 0) & exit_code.isin(C.EXITS["ok"], C.EXITS["technical"], C.EXITS["quality"])
    return F.when(F.coalesce(asked, F.lit(False)), 1).otherwise(0)
