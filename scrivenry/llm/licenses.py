"""Licence scans: Aho-Corasick over normalised words, shunting-yard over licence expressions."""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import DataFrame, functions as F

from scrivenry.llm.batches import map_rows

#: Phrases whose words must stand consecutively, with the labels of the contract.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases: label, weight of the evidence.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.6),
    "gnu affero general public license": ("agpl", 0.6),
    "gnu free documentation license": ("gfdl", 0.6),
    "mozilla public license": ("mpl", 0.6),
    "eclipse public license": ("epl", 0.6),
    "bsd license": ("bsd", 0.6),
    "redistribution and use in source and binary forms": ("bsd", 0.6),
    "permission is hereby granted free of charge": ("mit", 0.6),
    "boost software license": ("bsl", 0.6),
    "isc license": ("isc", 0.6),
    "cc by nc": ("cc-by-nc", 0.6),
    "cc by nd": ("cc-by-nd", 0.6),
    "cc by sa": ("cc-by-sa", 0.6),
    "creative commons attribution": ("cc-by", 0.6),
    "cc0": ("cc0", 0.5),
    "public domain": ("public-domain", 0.4),
    "all rights reserved": ("reserved", 0.3),
}
#: Licence identifiers that an expression may name: family label, permissive or not.
IDENTIFIERS = {
    "0BSD": ("bsd", True), "AGPL-3.0-only": ("agpl", False), "AGPL-3.0-or-later": ("agpl", False),
    "Apache-2.0": ("apache", True), "BSD-2-Clause": ("bsd", True), "BSD-3-Clause": ("bsd", True),
    "BSL-1.0": ("bsl", True), "CC-BY-4.0": ("cc-by", True), "CC-BY-NC-4.0": ("cc-by-nc", False),
    "CC-BY-ND-4.0": ("cc-by-nd", False), "CC-BY-SA-4.0": ("cc-by-sa", False), "CC0-1.0": ("cc0", True),
    "EPL-2.0": ("epl", False), "GFDL-1.3-only": ("gfdl", False), "GPL-2.0": ("gpl", False),
    "GPL-2.0-only": ("gpl", False), "GPL-2.0-or-later": ("gpl", False), "GPL-3.0": ("gpl", False),
    "GPL-3.0-only": ("gpl", False), "GPL-3.0-or-later": ("gpl", False), "ISC": ("isc", True),
    "LGPL-2.1-only": ("lgpl", False), "LGPL-3.0-only": ("lgpl", False), "MIT": ("mit", True),
    "MPL-2.0": ("mpl", False), "Unlicense": ("public-domain", True), "Zlib": ("zlib", True),
}
#: Exceptions that may follow WITH; each lifts the copyleft duty from the combined work.
EXCEPTIONS = ("Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "OpenSSL-exception")
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
LEXEME = re.compile(r"[()]|[A-Za-z0-9.-]+\+?|\S")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
IDENT = re.compile(r"[A-Za-z0-9.-]+\+?")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_BY_LOWER = {k.lower(): (k, *v) for k, v in IDENTIFIERS.items()}
_EXC_LOWER = {e.lower() for e in EXCEPTIONS}
_NORMAL = {
    i: (chr(i + 32) if 65 <= i <= 90 else " ") for i in range(128)
    if not (48 <= i <= 57 or 97 <= i <= 122)
}


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: postfix tokens of a licence expression, None where it is not one.

    WITH binds tighter than AND, AND tighter than OR; operators are read in either case.
    A trailing comment end is dropped.
    """
    lexemes = LEXEME.findall(re.sub(r"(\*/|-->).*$", "", expression))
    out: list[str] = []
    stack: list[str] = []
    operand = True  # an operand must come next
    for x in lexemes:
        low = x.lower()
        if x == "(":
            if not operand:
                return None
            stack.append(x)
        elif x == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in PRECEDENCE:
            if operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif IDENT.fullmatch(x):
            if not operand:
                return None
            out.append(x)
            operand = False
        else:
            return None
    if operand:
        return None
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


def evaluate(expression: str) -> tuple[bool, bool, list[str]]:
    """(valid, permissive, labels): AND needs both sides, OR one, WITH an exception lifts copyleft.

    Labels are the families of known identifiers and, in lower case, the unknown ones. An expression with an
    unknown identifier or exception is not valid, but keeps its labels; what is unknown is not permissive and lifts
    nothing. What is no expression at all has no labels.
    """
    postfix = to_postfix(expression)
    if postfix is None:
        return False, False, []
    valid = True
    labels: list[str] = []
    stack: list[tuple[str, bool, str]] = []  # kind, permissive, label that an unknown name would leave
    for x in postfix:
        if x in PRECEDENCE:
            if len(stack) < 2:
                return False, False, []
            right, left = stack.pop(), stack.pop()
            if x == "with":
                if left[0] not in ("licence", "unknown") or right[0] not in ("exception", "unknown"):
                    return False, False, []
                if right[0] == "unknown":
                    valid = False
                stack.append(("mix", left[1] or right[0] == "exception" and left[0] == "licence", ""))
                names = [left]
            elif "exception" in (left[0], right[0]):
                return False, False, []
            else:
                stack.append(("mix", left[1] and right[1] if x == "and" else left[1] or right[1], ""))
                names = [left, right]
            for kind, _, name in names:
                if kind == "unknown":
                    valid = False
                    labels.append(name)
        elif x.lower() in _EXC_LOWER:
            stack.append(("exception", True, ""))
        else:
            known = _BY_LOWER.get(x.lower()) or _BY_LOWER.get(x.rstrip("+").lower())
            if known:
                labels.append(known[1])
                stack.append(("licence", known[2], ""))
            elif x.lower().startswith("licenseref-"):
                labels.append(x.lower())
                stack.append(("licence", False, ""))
            else:
                stack.append(("unknown", False, x.lower()))
    if len(stack) != 1 or stack[0][0] == "exception":
        return False, False, []
    if stack[0][0] == "unknown":
        return False, False, [stack[0][2]]
    return valid, stack[0][1], labels


def normal_words(text: str) -> list[str]:
    """Words of the contract: A-Z lower-cased, runs of other ASCII than letters and digits part them."""
    return [w for w in text.translate(_NORMAL).split(" ") if w]


def _scanner():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    found: dict[str, list[tuple[str, str, float]]] = {}
    for phrase, label in BASE.items():
        found.setdefault(phrase, []).append(("base", label, 0.7))
    for phrase, (label, weight) in NOTICES.items():
        found.setdefault(phrase, []).append(("notice", label, weight))
    for name, (label, _) in IDENTIFIERS.items():
        words = normal_words(name)
        if len(words) > 1:  # one word alone ("mit") is also an ordinary word
            found.setdefault(" ".join(words), []).append(("identifier", label, 0.8))
    found.setdefault(TAG, []).append(("tag", "", 0.0))
    for phrase, kinds in found.items():
        automaton.add_word(f" {phrase} ", (phrase.count(" ") + 1, phrase, kinds))
    automaton.make_automaton()

    def scan(text: str | None):
        text = text or ""
        words = normal_words(text)
        normal = f" {' '.join(words)} " if words else ""
        starts: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        weights: dict[str, float] = {}
        hits: list[tuple[str, str, int, int]] = []
        tags: list[int] = []
        spaces = at = 0
        for end, (n, phrase, kinds) in automaton.iter(normal) if words else ():
            spaces += normal.count(" ", at, end)
            at = end
            for kind, label, weight in kinds:
                if kind == "tag":
                    tags.append(spaces - n)
                    continue
                labels.add(label)
                weights[phrase] = weight
                hits.append((kind, label, spaces - n, n))
                if kind == "base":
                    base.add(label)
                    starts.append(spaces - n)
        expressions = []
        words_of_text, gone = WORD.finditer(text) if tags else iter(()), 0
        for place in tags:
            first = next(islice(words_of_text, place - gone, None))
            gone = place + 1
            if m := TAG_LINE.match(text, first.start()):  # the tag's words in their fixed spelling
                valid, permissive, named = evaluate(m[1])
                expressions.append((m[1].strip(), valid, permissive))
                labels.update(named)
                weights[m[0]] = 0.95 if valid else 0.3
        miss = 1.0
        for w in weights.values():
            miss *= 1 - w
        return words, starts, base, labels, hits, expressions, 1 - miss

    return scan


OUT = (
    ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"),
    ("score", "double"), ("hits", "array<struct<kind:string,label:string,word:long,words:int>>"),
    ("expressions", "array<struct<expression:string,valid:boolean,permissive:boolean>>"),
)


def scan_licenses(df: DataFrame, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each input row: its key columns, counts, labels, hits, expressions and score.

    ``hits`` are (kind, label, first word, words); ``expressions`` are the tag lines with
    validity and whether a permissive reading satisfies them. ``score`` joins the weights of
    the distinct pieces of evidence as 1 - prod(1 - w). Null and empty texts have no words,
    no hits and score 0; repeated rows are scanned alike; an empty table gives no rows.
    The automaton is built once in each task; a row is one text, however long. Other columns are not looked at;
    a result named like a key column ends in ``_found``.
    """
    src = df.select(*key_cols, F.col(text_col).alias("__text"))

    def make():
        scan = _scanner()

        def one(*row):
            words, starts, base, labels, hits, expressions, score = scan(row[-1])
            return (
                *row[:-1], len(words), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score,
                [dict(zip(("kind", "label", "word", "words"), h)) for h in hits],
                [dict(zip(("expression", "valid", "permissive"), e)) for e in expressions],
            )

        return one

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    found = ", ".join(f"{n}_found {k}" if n in key_cols else f"{n} {k}" for n, k in OUT)
    return map_rows(src, make, f"{keys}, {found}")


def op6(docs: DataFrame) -> DataFrame:
    """Contract rows of op6, with the expressions as one more column."""
    return scan_licenses(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"
    )
