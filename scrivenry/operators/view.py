"""The processing view: what extraction sees of a source's text. Array functions in the JVM, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scrivenry import config as C
from scrivenry.functions import text as X
from scrivenry.functions.arrays import bind, running
from scrivenry.operators.headings import DROPPED, PAGE

FORMULA = r"[=^\\].*[+/^\\]"
CAPTION = r"(?i)^(figure|fig\.) ?[0-9]"
TABLE_RULE = r"^\|?( ?:?-+:? ?\|)+ ?(:?-+:? ?)?$"
HEADING = "^#{1,6} "
SYMBOLS = r"[#$%&*@^~|<>{}\\]"
#: Kinds of lines that the view leaves out.
LEFT_OUT = ("table_malformed", "table_dense", "figure_text", "noise")
#: A line without any of these is prose or blank, whatever the detectors say.
TELLING = r"[0-9=#$%&*@^~|<>{}\\]"
FORMULA_MARK = C.OMISSION + ": formula]"


def line_kind(line: Column) -> Column:
    """What a line is; the detectors are ours."""
    digits = F.regexp_count(line, F.lit("[0-9]"))
    return (
        F.when(F.startswith(line, F.lit(C.OMISSION)), "omission").when(line.rlike(CAPTION), "caption")
        .when(line.rlike(TABLE_RULE), "table_rule")
        .when(F.contains(line, F.lit("|")), F.when(~line.rlike(r"^\|.*\|$"), "table_malformed").when(
            digits > F.lit(C.TABLE_DIGIT_SHARE) * F.regexp_count(line, F.lit(r"[\p{L}\p{N}]")), "table_dense").otherwise("table"))
        .when(line.rlike(FORMULA), "formula").when(F.trim(line) == "", "blank")
        .when(digits > F.lit(0.5) * F.regexp_count(line, F.lit(r"\S")), "figure_text").otherwise("prose"))


def shown_line(line: Column) -> Column:
    """The line as the view shows it: a formula becomes its marker."""
    return F.when(line.rlike(FORMULA) & ~F.contains(line, F.lit("|")), F.lit(FORMULA_MARK)).otherwise(line)


def is_noise(line: Column) -> Column:
    return F.regexp_count(line, F.lit(SYMBOLS)) > F.lit(C.NOISE_SYMBOL_SHARE) * F.length(line)


def view_text(text: Column) -> Column:
    """The lines of a text that extraction sees, joined again; null is empty.

    References, contents and checklists go, up to the next heading of the first two levels, so an appendix
    stays. Prose, headings, captions and well-formed tables stay, formulas become markers; broken and
    number-dense tables, raw figure text and lines of symbols go.
    """
    def step(out: Column, line: Column) -> tuple[Column, Column]:
        heading = F.startswith(line, F.lit("#")) & line.rlike("^#{1,2} ") & ~line.rlike(PAGE)
        now = F.when(heading, X.heading_parts(line)["canonical"].rlike(DROPPED)).otherwise(out)
        kind = F.when(line.rlike(HEADING), "heading").otherwise(line_kind(line))
        kind = bind(kind, lambda k: F.when((k == "prose") & is_noise(line), "noise").otherwise(k))
        shown = F.when(line.rlike(HEADING), line).otherwise(shown_line(line))
        none = F.array().cast("array<string>")
        return now, F.when(now, none).when(~line.rlike(TELLING), F.array(line)).when(kind.isin(*LEFT_OUT), none).otherwise(F.array(shown))

    return F.array_join(running(F.split(F.coalesce(text, F.lit("")), "\n", -1), F.lit(False), "string", step), "\n")


def processing_view(sources: DataFrame, text_col: str = "text") -> DataFrame:
    """``sources`` with ``content`` (the view) and ``view_version`` in place of ``text_col``."""
    rest = [c for c in sources.columns if c not in (text_col, "content", "view_version")]
    return sources.select(*rest, view_text(F.col(text_col)).alias("content"), F.lit(C.VIEW_VERSION).alias("view_version"))


def lines(view: DataFrame, key: str = "source_id") -> DataFrame:
    """(source_id, ord, line) of the views that have a heading; others have no sections to find."""
    return view.where(F.col("content").rlike("(?m)" + HEADING)).select(
        F.col(key).alias("source_id"), F.posexplode(F.split("content", "\n", -1)).alias("ord", "line")).withColumn("ord", F.col("ord").cast("bigint"))
