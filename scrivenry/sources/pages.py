"""Web captures: HTML to Markdown, capture properties, note layout. Regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The rewriting steps in order, (pattern, replacement).
STEPS = (
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<(script|style|nav|footer|head)\b.*?</(script|style|nav|footer|head)>", ""),
    (r"(?is)<!doctype[^>]*>", ""),
    (r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', r"[\2](\1)"),
    (r"(?is)<h1\b[^>]*>", "\n\n# "),
    (r"(?is)<h2\b[^>]*>", "\n\n## "),
    (r"(?is)<h3\b[^>]*>", "\n\n### "),
    (r"(?is)<li\b[^>]*>", "\n- "),
    (r"(?is)<blockquote\b[^>]*>", "\n\n> "),
    (r"(?is)<br\s*/?>", "\n"),
    (r"(?is)<(p|div|article|section|table|tr|ul|ol)\b[^>]*>", "\n\n"),
    (r"(?is)<[^>]*>", ""),
    (r"[ \t]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n{3,}", "\n\n"),
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
H1 = r"(?is)<h1[^>]*>(.*?)</h1>"
AUTHOR = r"""(?i)<meta\b[^>]*name=["']author["'][^>]*content=["']([^"']*)["']"""
PUBLISHED = r"""(?i)<meta\b[^>]*property=["']article:published_time["'][^>]*content=["']([0-9]{4}-[0-9]{2}-[0-9]{2})"""
CANONICAL = r"""(?i)<link\b[^>]*rel=["']canonical["'][^>]*href=["'](https?://[^"']+)["']"""
HREF = r'(?i)<a\b[^>]*href="([^"]*)"'


def unescape(text: Column) -> Column:
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def to_markdown(html: Column) -> Column:
    """Markdown of a page: headings, lists, quotes and links stay; scripts, styles and navigation go."""
    for pattern, into in STEPS:
        html = F.regexp_replace(html, pattern, into.replace("\\1", "$1").replace("\\2", "$2"))
    return F.regexp_replace(unescape(html), r"^\s+|\s+$", "")


def title(html: Column) -> Column:
    return unescape(F.trim(F.regexp_extract(html, TITLE, 1)))


def properties(pages: DataFrame, captured: str) -> DataFrame:
    """The twelve capture properties; what a page does not say stays null, nothing is made up.

    The author, the date of publication and the canonical address are those of the page's head; ``captured`` is the
    day of the capture.
    """
    said = lambda pattern: F.nullif(F.trim(unescape(F.regexp_extract("html", pattern, 1))), F.lit(""))
    return pages.select(
        "page_id", F.lit("source").alias("type"), F.lit("external").alias("origin"), F.lit("raw").alias("knowledge_status"),
        F.lit("").alias("domain"), F.lit(captured).cast("date").alias("created"), F.lit(captured).cast("date").alias("updated"),
        F.lit("web").alias("source_type"), F.coalesce(said(CANONICAL), F.nullif(F.trim("url"), F.lit(""))).alias("source_url"),
        F.nullif(title(F.col("html")), F.lit("")).alias("title"), said(AUTHOR).alias("author"),
        F.try_to_date(said(PUBLISHED), "yyyy-MM-dd").alias("published"), F.lit(False).alias("human_verified"),
    )


def note_body(title_: Column, url: Column, content: Column) -> Column:
    return F.concat(
        F.lit("# "), title_, F.lit("\n\n## Source\n\n"), url, F.lit("\n\n## Content\n\n"), content,
        F.lit("\n\n## My Highlights\n\n## Related\n"))
