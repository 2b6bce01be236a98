"""Concept extraction behind a provider, and the strict check of its replies."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scrivenry import config as C
from scrivenry.functions import text as X
from scrivenry.sources.tables import materialise, worker_path

#: What a reply must be: one JSON object with these members.
REPLY = "title string, role string, definition string, key_points array<string>, evidence array<struct<claim:string,excerpt:string>>"
ROLES = ("mechanism", "component", "method_entity", "baseline", "analysis", "dataset", "metric", "concept")


def fake_concepts(chunks: DataFrame, id_col: str) -> DataFrame:
    """The deterministic provider: a chunk's first sentence (80 characters at most) is its concept."""
    t = F.col("text")
    x = chunks.select(
        id_col, "chunk_no", F.trim(F.regexp_extract(t, r"^([^.!?\n]{1,80})", 1)).alias("title"),
        t.substr(1, C.EXCERPT_CHARS).alias("excerpt")).where("title <> ''")
    return x.select(id_col, "chunk_no", "title", X.identity(F.col("title")).alias("identity"), "excerpt")


def fake_reply(text: Column) -> Column:
    """The deterministic provider's whole reply: a chunk's first sentence is title, definition, claim and key point,
    its first characters the excerpt. Null where the chunk begins without one."""
    title = F.trim(F.regexp_extract(text, r"^([^.!?\n]{1,80})", 1))
    evidence = F.array(F.struct(title.alias("claim"), text.substr(1, C.EXCERPT_CHARS).alias("excerpt")))
    return F.when(title != "", F.to_json(F.struct(
        title.alias("title"), F.lit("concept").alias("role"), title.alias("definition"), F.array(title).alias("key_points"), evidence.alias("evidence"))))


def extract(
    chunks: DataFrame, provider: Callable[..., str], id_col: str, timeout_s: float = C.TIMEOUT_S, max_tokens: int = C.MAX_OUTPUT_TOKENS,
) -> DataFrame:
    """(id, chunk_no, reply, failure): one reply of the provider for each chunk, written once.

    A model does not repeat itself, so the replies are a table before anything reads them. The provider
    gets the text and, where it takes them, ``temperature`` 0, ``think`` false, ``max_tokens`` and ``timeout_s``.
    A reply after ``timeout_s`` seconds is refused; an error, a refusal or no reply is a null reply with its
    kind in ``failure`` (timeout, error, empty).
    """
    kind = chunks.schema[id_col].dataType.simpleString()
    options = {"temperature": 0, "think": False, "max_tokens": max_tokens, "timeout_s": timeout_s}
    known = inspect.signature(provider).parameters
    every = any(p.kind is p.VAR_KEYWORD for p in known.values())
    options = {k: v for k, v in options.items() if every or k in known}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(text: str) -> tuple[str | None, str | None]:
            began = time.monotonic()
            try:
                reply = provider(text, **options)
            except TimeoutError:
                return None, "timeout"
            except Exception:  # whatever a model connection may raise is a failed chunk
                return None, "error"
            if time.monotonic() - began > timeout_s:
                return None, "timeout"
            return reply, None if reply else "empty"

        for p in parts:
            got = [ask(t) for t in p["text"]]
            yield pd.DataFrame({id_col: p[id_col], "chunk_no": p["chunk_no"], "reply": [g[0] for g in got], "failure": [g[1] for g in got]})

    worker_path(chunks.sparkSession)
    return materialise(chunks.select(id_col, "chunk_no", "text").mapInPandas(
        run, f"{id_col} {kind}, chunk_no bigint, reply string, failure string"), "replies")


def repair(reply: Column) -> Column:
    """The one repair of syntax: code fences off, trailing commas off."""
    bare = F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*|\s*```$", "")
    return F.regexp_replace(bare, r",\s*([}\]])", "$1")


# The types of a reply's members, as the variant functions print them, in order of name.
SHAPE = (r"^OBJECT<definition: STRING, evidence: ARRAY<OBJECT<claim: STRING, excerpt: STRING>>, "
         r"key_points: ARRAY<(STRING|VOID)>, role: STRING, title: STRING>$")


def strict(reply: Column) -> Column:
    """The reply is one JSON object with exactly the members of REPLY, each of its type."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(reply)).rlike(SHAPE), F.lit(False))


def valid(parsed: Column) -> Column:
    filled = F.forall(parsed["evidence"], lambda e: e["claim"].isNotNull() & e["excerpt"].isNotNull())
    return F.coalesce(
        parsed["title"].isNotNull() & (F.trim(parsed["title"]) != "") & parsed["role"].isin(*ROLES)
        & parsed["definition"].isNotNull() & (F.size(parsed["evidence"]) > 0) & filled
        & F.forall(parsed["key_points"], lambda k: k.isNotNull()), F.lit(False))


def check_replies(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """``replies`` with ``concept`` and ``status``: ok, repaired or failed; repaired text is checked in full.

    Unknown, missing or null members and members of another type fail.
    """
    mended = repair(F.col(reply_col))
    x = replies.withColumn("__a", F.when(strict(F.col(reply_col)), F.from_json(reply_col, REPLY))).withColumn("__ok", valid(F.col("__a"))).withColumn(
        "__b", F.when(~F.col("__ok") & strict(mended), F.from_json(mended, REPLY)))
    status = F.when(F.col(reply_col).isNull(), "failed").when(F.col("__ok"), "ok").when(
        valid(F.col("__b")), "repaired").otherwise("failed")
    return x.withColumn("status", status).withColumn(
        "concept", F.when(F.col("status") == "ok", F.col("__a")).when(F.col("status") == "repaired", F.col("__b"))).drop("__a", "__b", "__ok")
