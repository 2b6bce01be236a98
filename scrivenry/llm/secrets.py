"""Secret scans: fixed patterns, plus character Markov models compared by log-likelihood ratio.

DataFrame functions only.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scrivenry.functions.arrays import bind, running

#: Kind, pattern, least length of the group that is measured, that group.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
)
#: Patterns that find the matches of a kind that are long enough, and no others; ``assign`` has none, because a short
#: value takes its text from what follows.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: One of these stands in every text (in lower case) with a match of ``assign``.
ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")
METHOD = "markov"
#: Symbols of the models; everything else parts tokens.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Least mean log-likelihood ratio for each transition, in nats.
THRESHOLD = 0.2
#: A token with fewer distinct symbols is a repetition, not a key.
DISTINCT = 8
WORDS = (
    "get set load store user name file path list map index value count total time date order item "
    "record field table column query parse read write open close start stop begin end first last next "
    "previous current default config option setting server client request response message handler "
    "manager service factory builder controller model view data type class object string number array "
    "buffer stream input output error warning result status state event listener callback function "
    "method variable constant parameter argument return call create update delete insert select find "
    "search filter sort merge split join convert format encode decode version test case group member "
    "account address phone customer product price payment invoice report summary detail page window "
    "strasse gesellschaft verwaltung schifffahrt wissenschaft entwicklung information presentation developpement gouvernement "
    "organisation utilisateur desarrollo administracion aplicacion usuario pagina siguiente "
    "layout image color font size width height position length weight international documentation"
).split()


def labelled_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(text, random): random strings in three alphabets and identifiers in five spellings, by rule."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample-"), i.cast("string")), 512)
    b64 = F.translate(F.base64(F.unhex(digest)), "\r\n", "")
    size = (F.pmod(F.xxhash64(i), F.lit(25)) + 20).cast("int")
    random = F.element_at(
        F.array(b64, F.translate(b64, "+/=", "xYz"), digest), (F.pmod(i, F.lit(3)) + 1).cast("int")
    ).substr(F.lit(1), size)
    words = F.array(*[F.lit(w) for w in WORDS])
    chosen = F.transform(
        F.sequence(F.lit(1), (F.pmod(F.xxhash64(i, F.lit("n")), F.lit(4)) + 2).cast("int")),
        lambda k: F.element_at(words, (F.pmod(F.xxhash64(i, k), F.lit(len(WORDS))) + 1).cast("int")),
    )
    camel = F.array_join(F.transform(chosen, lambda w: F.initcap(w)), "")
    number = F.pmod(F.xxhash64(i, F.lit("d")), F.lit(2500)).cast("string")
    name = F.element_at(
        F.array(
            F.array_join(chosen, "_"), F.array_join(chosen, "-"), camel, F.upper(F.array_join(chosen, "_")),
            F.array_join(chosen, "/"),
        ),
        (F.pmod(i, F.lit(5)) + 1).cast("int"),
    )
    name = F.when(F.pmod(i, F.lit(2)) == 0, F.concat(name, F.lit("_"), number)).otherwise(name)
    rows = spark.range(n)
    return rows.select(random.alias("text"), F.lit(True).alias("random")).union(
        rows.select(name.alias("text"), F.lit(False).alias("random"))
    )


def train(samples: DataFrame, smoothing: float = 4.0) -> list[float]:
    """Log-likelihood ratio of every transition, from samples (text, random).

    The result has one number for each pair of symbols, so what reaches the driver is bounded
    by the alphabet (67 * 67), whatever the samples are. Texts that are null or shorter than
    two symbols teach nothing; without samples every ratio is 0.
    """
    k = len(ALPHABET)
    codes = F.transform(F.split("text", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("codes") - 1),
        lambda j: F.struct(F.get("codes", j - 1).alias("a"), F.get("codes", j).alias("b")),
    )
    counted = (
        samples.where("text is not null and random is not null and length(text) > 1")
        .select("random", codes.alias("codes"))
        .select("random", F.explode(pairs).alias("p"))
        .where("p.a > 0 and p.b > 0")
        .groupBy("random", "p.a", "p.b").count().collect()
    )
    import math

    counts = {c: [[smoothing] * k for _ in range(k)] for c in (True, False)}
    for r in counted:
        counts[r["random"]][r["a"] - 1][r["b"] - 1] += r["count"]
    rows = {c: [sum(x) for x in counts[c]] for c in counts}
    return [
        math.log(counts[True][a][b] / rows[True][a]) - math.log(counts[False][a][b] / rows[False][a])
        for a in range(k) for b in range(k)
    ]


def mean_ratio(token: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio over the transitions of ``token`` (symbols of the alphabet only)."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    folded = F.aggregate(
        codes,
        F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda s, c: F.struct(
            c.alias("last"),
            (s["sum"] + F.when((s["last"] > 0) & (c > 0),
                               F.element_at(ratios, (s["last"] - 1) * len(ALPHABET) + c)).otherwise(0.0)).alias("sum"),
        ),
    )
    return folded["sum"] / F.greatest(F.length(token) - 1, F.lit(1))


SPAN = "struct<start:int,end:int,match:string>"


def _placed(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches that ``keep`` keeps, as struct(start, end, match), in code points.

    The text between matches comes from ``split`` by the same pattern, so positions are running sums
    of lengths.
    """
    def step(at: Column, m: Column) -> tuple[Column, Column]:
        start = at + m["gap"]
        end = start + F.length(m["match"])
        found = F.array(F.struct(start.alias("start"), end.alias("end"), m["match"].alias("match")))
        kept = m["match"].isNotNull() if keep is None else m["match"].isNotNull() & keep(m["match"])
        return F.coalesce(end, at), F.when(kept, found).otherwise(F.array().cast(f"array<{SPAN}>"))

    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    matches = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    return running(matches, F.lit(0), SPAN, step)


def _touched(spans: Column, tokens: Column) -> Column:
    """Tokens that overlap no span. Both are in order and free of overlaps among themselves.

    In the order of all starts a token overlaps the last span before it, or the neighbour after it, or none.
    """
    event = lambda x, own: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), x["match"].alias("match"))
    events = F.array_sort(F.concat(F.transform(spans, lambda x: event(x, 0)), F.transform(tokens, lambda x: event(x, 1))))
    none = F.array().cast(f"array<{SPAN}>")

    def held(s: Column) -> Column:
        return F.when(s["end"] > 0, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))).otherwise(none)

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        # state: where the last span ends, and a token that waits for its neighbour (end 0: none)
        free = (x["own"] == 1) & (x["start"] >= s["span"])
        state = F.struct(
            F.when(x["own"] == 0, F.greatest(s["span"], x["end"])).otherwise(s["span"]).alias("span"), x["start"].alias("start"),
            F.when(free, x["end"]).otherwise(0).alias("end"), x["match"].alias("match"))
        return state, F.when((x["own"] == 0) & (x["start"] < s["end"]), none).otherwise(held(s))

    zero = F.struct(F.lit(0).alias("span"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("match"))
    return running(events, zero, SPAN, step, held)


def find_secrets(
    df: DataFrame, ratios: list[float], text_col: str = "text", out: str = "secret_spans",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``df`` with ``out``: an array of struct(start, rank, end, kind), by start and kind.

    Base kinds are matched leftmost and non-overlapping, each on its own, and matches that are
    too short are dropped. The models then judge every run of 20 or more alphabet symbols that
    has a letter, a digit and eight distinct symbols and touches no base span. Null and empty texts have no
    spans; repeated rows are scanned alike; very long texts cost little more than their length. Columns
    named like ``out``, __base or __more are replaced or dropped, others stay; no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    (_, assign, least, group), *_ = KINDS
    low = F.lower(text)
    named = F.contains(low, F.lit(ASSIGN_WORDS[0]))
    for word in ASSIGN_WORDS[1:]:
        named = named | F.contains(low, F.lit(word))
    found = {
        "assign": F.when(named, _placed(text, assign, lambda m: F.length(F.regexp_extract(m, assign, group)) >= least)),
        "access": F.when(F.contains(text, F.lit("AKIA")), _placed(text, LONG["access"])),
        "hex": F.when(text.rlike(LONG["hex"]), _placed(text, LONG["hex"])),
    }

    def tag(rank: int, kind: str) -> Column:
        return F.transform(found[kind].otherwise(none), lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["match"].alias("match")))

    tagged = [tag(rank, kind) for rank, (kind, *_) in enumerate(KINDS)]
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in ratios])), "array<double>")

    def likely(m: Column) -> Column:
        # access and hex spans lie within one run, so a run shows them itself
        return (
            m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike(LONG["access"]) & ~m.rlike(LONG["hex"])
            & (F.size(F.array_distinct(F.split(m, ""))) >= DISTINCT) & (mean_ratio(m, table) >= threshold))

    assigned = F.filter("__base", lambda b: b["kind"] == "assign")
    judged = F.when(text.rlike(TOKEN), _touched(assigned, _placed(text, TOKEN, likely))).otherwise(none)
    rows = df.withColumn("__base", F.concat(*tagged))
    return (
        once(rows, "__base").withColumn("__more", judged)
        .withColumn(out, F.array_sort(F.concat(
            F.transform("__base", lambda b: b.dropFields("match")),
            F.transform("__more", lambda m: F.struct(
                m["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), m["end"].alias("end"), F.lit(METHOD).alias("kind"))),
        )))
        .drop("__base", "__more").transform(lambda x: once(x, out))
    )


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` where later expressions read column ``name`` and never compute it again."""
    rest = [F.col(c) for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(F.col(name))).alias(name))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every maximal stretch of spans replaced by ``mark``; null stays null.

    ``substr`` walks a text from its start, so k stretches are cut in about sqrt(k) parts of the text.
    """
    def step(s: Column, m: Column) -> tuple[Column, Column]:
        joins = m["start"] <= s["end"]
        state = F.struct(
            F.when(joins, s["start"]).otherwise(m["start"]).alias("start"), F.greatest(s["end"], m["end"]).alias("end"))
        return state, F.when(joins | (s["end"] < 0), none).otherwise(F.array(s))

    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(-2).alias("start"), F.lit(-1).alias("end"))
    merged = running(spans, zero, "struct<start:int,end:int>", step, lambda s: F.when(s["end"] < 0, none).otherwise(F.array(s)))

    def after(cuts: Column, i: Column) -> Column:
        return F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["end"])

    def cut(cuts: Column) -> Column:
        n = F.size(cuts)
        width = F.ceil(F.sqrt(n)).cast("int")

        def part(g: Column) -> Column:
            own = F.slice(cuts, g * width + 1, width)
            start = after(cuts, g * width)
            own_text = text.substr(start + 1, F.get(cuts, F.least((g + 1) * width, n) - 1)["end"] - start)
            return bind(own_text, lambda t: bind(own, lambda mine: F.array_join(F.transform(mine, lambda c, i: F.concat(
                t.substr(F.when(i == 0, start).otherwise(after(mine, i)) - start + 1,
                         c["start"] - F.when(i == 0, start).otherwise(after(mine, i))), F.lit(mark))), "")))

        parts = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), part)
        return F.concat(F.array_join(parts, ""), text.substr(F.get(cuts, n - 1)["end"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(bind(merged, cut))


def redact_secrets(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; a column n_chars follows a changed text."""
    found = find_secrets(docs, ratios, out="__secrets")
    out = found.withColumn("text", redact(F.col("text"), F.col("__secrets")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(
            F.size("__secrets") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ","
    )


def op1(docs: DataFrame) -> DataFrame:
    """Contract rows of op1, with the number of spans that the models add."""
    found = find_secrets(docs.select("doc_id", "text"), train(labelled_samples(docs.sparkSession)))
    s = F.col("secret_spans")
    n = lambda kind: F.size(F.filter(s, lambda m: m["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k, *_ in KINDS],
        F.sha2(_joined(F.filter(s, lambda m: m["kind"] != METHOD)).cast("binary"), 256).alias("base_sha256"),
        _joined(s).alias("spans"),
        n(METHOD).alias(f"n_{METHOD}"),
    )
