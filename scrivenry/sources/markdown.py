"""Markdown notes and binary papers as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scrivenry import config as C
from scrivenry.functions import text as X
from scrivenry.sources.batches import bound_batches, map_batches, slices

FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, frontmatter, body) of every Markdown file under ``path``; no frontmatter gives null."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    front = F.regexp_extract("value", FRONT, 1)
    has = F.col("value").rlike(FRONT)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.when(has, front).alias("frontmatter"),
                      F.when(has, F.regexp_extract("value", FRONT, 2)).otherwise(F.col("value")).alias("body"))


def parse_properties(frontmatter: Column) -> Column:
    """map<string,string> of YAML properties; lists become JSON text, unknown ones stay, bad YAML is null."""
    import json

    bound_batches(SparkSession.active())

    @F.pandas_udf("map<string,string>")
    def run(s: pd.Series) -> pd.Series:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        def one(x):
            try:
                got = yaml.load(x, loader) if x else None
            except yaml.YAMLError:
                return None
            if not isinstance(got, dict):
                return None
            return {str(k): None if v is None else json.dumps(v, default=str) if isinstance(v, (list, dict)) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in got.items()}

        return s.map(one)

    return run(frontmatter)


def section(body: Column, name: str) -> Column:
    """Text under the level-2 heading ``name``, up to the next one."""
    found = F.regexp_extract(body, rf"(?ms)^## {name}\s*?$\n?(.*?)(?=^## |\z)", 1)
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def content(body: Column) -> Column:
    """The Content section of a source note, with the headings it holds: up to the last section for people's marks."""
    found = F.regexp_extract(body, r"(?ms)^## Content\s*?$\n?(.*)^## My Highlights\s*?$", 1)
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def plain_extractor(content: bytes) -> str:
    """Extractor for text files, and the stand-in where no PDF library is installed."""
    return content.decode("utf-8", "replace")


def pdf_extractor(content: bytes) -> str:
    """pypdf, where it is installed."""
    import io

    from pypdf import PdfReader

    return "\n".join(f"### Page {i}\n{p.extract_text()}" for i, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1))


def layout_extractor(content: bytes) -> str:
    """The layout-aware extractor, where its library is installed."""
    import pymupdf
    import pymupdf4llm

    pages = pymupdf4llm.to_markdown(pymupdf.open(stream=content), page_chunks=True)
    return "\n".join(f"### Page {i}\n{p['text']}" for i, p in enumerate(pages, 1))


EXTRACTORS: dict[str, Callable[[bytes], str]] = {"plain": plain_extractor, "pypdf": pdf_extractor, "layout": layout_extractor}


def default_extractor() -> str:
    """The layout-aware one where it can run, else text; ``pypdf`` only by name."""
    from importlib.util import find_spec

    return "layout" if find_spec("pymupdf4llm") else "plain"


def ingest(spark: SparkSession, path: str, method: str = "plain") -> DataFrame:
    """(source_file, extraction_method, content, exit_code): low text is refused with code 3, content null."""
    return extract(spark.read.format("binaryFile").load(path).select("path", "content"), method)


def extract(files: DataFrame, method: str = "plain") -> DataFrame:
    """``ingest`` of (path, content) rows, wherever the bytes come from."""
    extractor = EXTRACTORS[method]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few files at a time, whatever the batches of the session hold
        for b in slices(batches):
            found = [extractor(c.as_py()) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["source_file", "content"])

    raw = map_batches(files.select("path", "content"), run, "source_file string, content string")
    low = F.length(F.trim("content")) < C.LOW_TEXT_CHARS
    return raw.select("source_file", F.lit(method).alias("extraction_method"), F.when(~low, X.escape_angle(F.col("content"))).alias("content"),
                      F.when(low, C.EXITS["ocr"]).otherwise(C.EXITS["ok"]).alias("exit_code"))
