"""Headings, sections, method subsections and pages of line-ordered sources (source_id, ord, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from scrivenry.functions import text as X
from scrivenry.functions.arrays import bind, running

# Canonical headings of sections that extraction never sees.
DROPPED = r"^(references|bibliography|contents|table of contents|(neurips )?paper checklist|checklist)$"
PAGE = r"^### Page ([0-9]+)$"


def parse(lines: DataFrame) -> DataFrame:
    """Lines with start offset, page marker, heading level (0: no heading), number, depth and canonical form."""
    order = Window.partitionBy("source_id").orderBy("ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    page = F.regexp_extract("line", PAGE, 1)
    h = X.heading_parts(F.col("line"))
    return lines.select(
        "*", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("bigint").alias("start"),
        F.when(page != "", page.cast("bigint")).alias("page"),
        F.when(page != "", F.lit(0)).otherwise(h["level"]).cast("bigint").alias("level"),
        h["number"].alias("number"), h["depth"].cast("bigint").alias("depth"), h["canonical"].alias("canonical"), h["text"].alias("heading"))


def spans(parsed: DataFrame) -> DataFrame:
    """(source_id, ord, ..., start, end) of every heading: to the next heading that closes it.

    Between numbered headings the depth decides, else the Markdown level; page markers close nothing.
    A document's headings meet each other only inside their source.
    """
    total = parsed.groupBy("source_id").agg((F.max(F.col("start") + F.length("line"))).alias("total"))
    h = parsed.where("level > 0")
    later = h.select(F.col("source_id").alias("s2"), F.col("start").alias("start2"), F.col("level").alias("level2"),
                     F.col("number").alias("number2"), F.col("depth").alias("depth2"))
    closes = F.when((F.col("number") != "") & (F.col("number2") != ""), F.col("depth2") <= F.col("depth")).otherwise(
        F.col("level2") <= F.col("level"))
    ends = (
        h.join(later, (F.col("source_id") == F.col("s2")) & (F.col("start2") > F.col("start")) & closes)
        .groupBy("source_id", "ord").agg(F.min("start2").alias("end")))
    return (
        h.join(ends, ["source_id", "ord"], "left").join(total, "source_id")
        .withColumn("end", F.coalesce("end", "total")).drop("total", "page", "line"))


def method_subsections(parsed: DataFrame) -> DataFrame:
    """Headings inside a method root that are not of the excluded kinds, with id and pages.

    A repeated heading counts up in its source, so ids differ. Pages are the marker in force at the
    heading and those inside the span.
    """
    all_ = spans(parsed)
    roots = all_.where(X.is_method_root(F.col("canonical"))).select(
        F.col("source_id").alias("rs"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    inside = all_.join(roots, (F.col("source_id") == F.col("rs")) & (F.col("start") > F.col("r_start")) & (F.col("start") < F.col("r_end")), "left_semi")
    kept = inside.where(~X.is_excluded_subsection(F.col("canonical")))
    nth = F.row_number().over(Window.partitionBy("source_id", "canonical").orderBy("start"))
    named = kept.withColumn("sub_id", X.subsection_id(F.col("canonical"), nth))
    markers = parsed.where("page is not null").select(F.col("source_id").alias("ps"), F.col("start").alias("p_start"), "page")
    before = (
        named.join(markers, (F.col("source_id") == F.col("ps")) & (F.col("p_start") < F.col("start")), "left")
        .groupBy("source_id", "sub_id").agg(F.max_by("page", "p_start").alias("first_page")))
    within = (
        named.join(markers, (F.col("source_id") == F.col("ps")) & (F.col("p_start") >= F.col("start")) & (F.col("p_start") < F.col("end")))
        .groupBy("source_id", "sub_id").agg(F.collect_set("page").alias("more")))
    return (
        named.join(before, ["source_id", "sub_id"]).join(within, ["source_id", "sub_id"], "left")
        .withColumn("pages", F.array_sort(F.array_distinct(F.array_compact(F.concat(
            F.array("first_page"), F.coalesce("more", F.array().cast("array<bigint>")))))))
        .select("source_id", "sub_id", "canonical", "heading", "start", "end", "pages"))


def outlines(contents: DataFrame) -> DataFrame:
    """``contents`` (source_id, content; one row each) with ``marks`` (headings and page markers in order, as ``parse`` and
    ``spans`` have them), ``total`` (characters) and ``lines``. A projection, linear in text and headings."""
    # only lines that begin like a heading are looked at, so the text is cut before these
    parts = F.split("content", r"\n(?=#{1,6} )", -1)
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def place(s: Column, x: Column) -> tuple[Column, Column]:
        after = F.struct((s["ord"] + x["feeds"] + 1).alias("ord"), (s["start"] + x["chars"] + 1).alias("start"))
        return after, F.array(F.struct(s["ord"].alias("ord"), s["start"].alias("start"), x["line"].alias("line"), x["body"].alias("body"), x["chars"].alias("chars")))

    sized = F.transform(parts, lambda x: F.struct(
        feeds(x).cast("bigint").alias("feeds"), F.length(x).cast("bigint").alias("chars"), F.substring_index(x, "\n", 1).alias("line"),
        F.regexp_like(x, F.lit(r"^[^\n]*+\n\s*+\S")).alias("body")))
    zero = F.struct(F.lit(0).cast("bigint").alias("ord"), F.lit(0).cast("bigint").alias("start"))
    placed = running(sized, zero, "struct<ord:bigint,start:bigint,line:string,body:boolean,chars:bigint>", place)

    def mark(x: Column) -> Column:
        h, page = X.heading_parts(x["line"]), F.regexp_extract(x["line"], PAGE, 1)
        return F.struct(
            x["ord"].alias("ord"), x["start"].alias("start"), F.when(page != "", page.cast("bigint")).alias("page"),
            F.when(page != "", F.lit(0)).otherwise(h["level"]).cast("bigint").alias("level"), h["number"].alias("number"), h["depth"].cast("bigint").alias("depth"),
            h["canonical"].alias("canonical"), h["text"].alias("heading"), x["body"].alias("body"), F.length(x["line"]).cast("bigint").alias("width"), x["chars"].alias("chars"))

    marks = F.transform(F.filter(placed, lambda x: x["line"].rlike("^#{1,6} ")), mark)
    x = contents.withColumn("marks", marks).withColumn("total", F.length("content").cast("bigint")).withColumn("lines", feeds(F.col("content")).cast("bigint") + 1)
    return x.withColumn("marks", _ended(F.col("marks"), F.col("total")))


MARK = "ord:bigint,start:bigint,page:bigint,level:bigint,number:string,depth:bigint,canonical:string,heading:string,body:boolean,width:bigint,chars:bigint,seen:int,end:bigint,to:int"


def _ended(marks: Column, total: Column) -> Column:
    """``marks`` with ``seen`` (page markers before), ``end`` and ``to`` (page markers before the end).

    One pass from the left counts markers. One from the right holds, for each level, the next heading of that level or
    a higher one, once of all headings and once of those without number, and the next numbered headings of falling depth.
    """
    same = "ord start page level number depth canonical heading body width chars".split()
    kind = f"struct<{MARK}>"

    def count(n: Column, m: Column) -> tuple[Column, Column]:
        blank = [F.lit(None).cast("bigint").alias("end"), F.lit(None).cast("int").alias("to")]
        return n + m["page"].isNotNull().cast("int"), F.array(F.struct(*[m[c].alias(c) for c in same], n.alias("seen"), *blank))

    def close(s: Column, m: Column) -> tuple[Column, Column]:
        here = F.struct(m["start"].alias("at"), m["seen"].alias("seen"), m["depth"].alias("depth"))
        numbered, heading = m["number"] != "", m["level"] > 0
        put = lambda old, hit: F.when(hit, F.transform(old, lambda x, i: F.when(i + 1 >= m["level"], here).otherwise(x))).otherwise(old)
        deep = F.when(heading & numbered, F.concat(F.array(here), F.filter(s["deep"], lambda x: x["depth"] < m["depth"]))).otherwise(s["deep"])
        level = F.greatest(m["level"], F.lit(1)).cast("int")
        by_depth = F.get(F.filter(s["deep"], lambda x: x["depth"] <= m["depth"]), F.lit(0))
        by_level = F.get(s["bare"], level - 1)
        nearer = F.when(by_depth["at"].isNull() | (by_level["at"] < by_depth["at"]), by_level).otherwise(by_depth)
        next_ = F.when(numbered, nearer).otherwise(F.get(s["every"], level - 1))
        # null: to the end of the text
        out = F.struct(*[m[c].alias(c) for c in (*same, "seen")], next_["at"].alias("end"), next_["seen"].alias("to"))
        state = F.struct(put(s["every"], heading).alias("every"), put(s["bare"], heading & ~numbered).alias("bare"), deep.alias("deep"))
        return state, F.array(out)

    held = "array<struct<at:bigint,seen:int,depth:bigint>>"
    none = F.array_repeat(F.lit(None).cast("struct<at:bigint,seen:int,depth:bigint>"), 6)
    zero = F.struct(none.alias("every"), none.alias("bare"), F.array().cast(held).alias("deep"))
    counted = running(marks, F.lit(0), kind, count)
    closed = F.reverse(running(F.reverse(counted), zero, kind, close))
    pages = F.size(F.filter(marks, lambda m: m["page"].isNotNull()))
    return bind(pages, lambda n: F.transform(closed, lambda m: m.withField("end", F.coalesce(m["end"], total)).withField("to", F.coalesce(m["to"], n))))


def subsections(marks: Column) -> Column:
    """What ``method_subsections`` finds, as an array in order of start, from the marks of ``outlines``.

    ``filled``: there is more than blanks below the heading line, whose length is ``width``.
    """
    heads = lambda m: F.filter(m, lambda x: x["level"] > 0)

    def inside(reach: Column, x: Column) -> tuple[Column, Column]:
        # roots begin before; one that ends behind the start is around it
        mine = F.when((x["start"] < reach) & ~X.is_excluded_subsection(x["canonical"]), F.array(x)).otherwise(F.array().cast(f"array<struct<{MARK}>>"))
        return F.when(X.is_method_root(x["canonical"]), F.greatest(reach, x["end"])).otherwise(reach), mine

    def nth(s: Column, x: Column) -> tuple[Column, Column]:
        n = F.when(s["c"] == x["c"], s["n"] + 1).otherwise(F.lit(1))
        return F.struct(x["c"].alias("c"), n.alias("n")), F.array(F.struct(x["start"].alias("start"), n.alias("n"), x["m"].alias("m")))

    kept = running(heads(marks), F.lit(-1).cast("bigint"), f"struct<{MARK}>", inside)
    by_name = F.array_sort(F.transform(kept, lambda x: F.struct(x["canonical"].alias("c"), x["start"].alias("start"), x.alias("m"))))
    zero = F.struct(F.lit(None).cast("string").alias("c"), F.lit(0).alias("n"))
    ranked = F.array_sort(running(by_name, zero, f"struct<start:bigint,n:int,m:struct<{MARK}>>", nth))
    pages = F.transform(F.filter(marks, lambda m: m["page"].isNotNull()), lambda m: m["page"])

    def one(r: Column, pages: Column) -> Column:
        m = r["m"]
        first = F.greatest(m["seen"], F.lit(1))
        # the marker in force at the heading and those inside
        shown = F.array_sort(F.array_distinct(F.slice(pages, first, F.greatest(m["to"] - first + 1, F.lit(0)))))
        return F.struct(
            X.subsection_id(m["canonical"], r["n"]).alias("sub_id"), m["canonical"].alias("canonical"), m["heading"].alias("heading"), m["start"].alias("start"),
            m["end"].alias("end"), shown.alias("pages"), m["width"].alias("width"), (m["body"] | (m["start"] + m["chars"] + 1 < m["end"])).alias("filled"))

    return bind(pages, lambda p: F.transform(ranked, lambda r: one(r, p)))


def kept_sections(marks: Column, lines: Column) -> Column:
    """array<struct(section, lines)> of what ``kept_lines`` keeps, in order: one for each heading of the first two levels."""
    def sized(tops: Column) -> Column:
        return F.transform(tops, lambda x, i: F.struct(x["section"].alias("section"), (F.coalesce(F.get(tops, i + 1)["ord"], lines) - x["ord"]).alias("lines")))

    begin = F.array(F.struct(F.lit(0).cast("bigint").alias("ord"), F.lit("").alias("section")))
    tops = F.transform(F.filter(marks, lambda m: (m["level"] > 0) & (m["level"] <= 2)), lambda m: F.struct(m["ord"].alias("ord"), m["canonical"].alias("section")))
    return F.filter(bind(F.concat(begin, tops), sized), lambda x: (x["lines"] > 0) & ~x["section"].rlike(DROPPED))


def kept_lines(parsed: DataFrame) -> DataFrame:
    """Lines outside references, contents and checklists; an appendix heading opens the text again."""
    top = (F.col("level") > 0) & (F.col("level") <= 2)
    upto = Window.partitionBy("source_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    named = F.last(F.when(top, F.col("canonical")), ignorenulls=True).over(upto)
    return parsed.withColumn("section", F.coalesce(named, F.lit(""))).where(~F.col("section").rlike(DROPPED))
