"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from scrivenry.llm.batches import map_batches, release, slices
from scrivenry.sources.tables import materialise

#: Hash buckets of words.
BUCKETS = 1 << 15
#: Rank of the pairwise interactions.
RANK = 8
#: Labelled rows that are fitted at most; taken by a hash of the key, so spread over the table.
SAMPLE = 8000
#: Feature values (8 bytes each) of these rows that reach the driver at most.
SAMPLE_VALUES = 16_000_000
STATS = (
    "chars", "words", "mean_word", "longest_word", "upper", "digit", "symbol", "space", "other", "distinct",
    "top_word", "repeated_lines", "line_words", "end_marks", "declared_chars", "one",
)
_CLASS = np.full(256, 5, np.uint8)  # 5: bytes of non-ASCII characters
_CLASS[:128] = 3
for _a, _b, _c in ((65, 90, 0), (97, 122, 1), (48, 57, 2)):
    _CLASS[_a:_b + 1] = _c
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def statistics(text: str, words: Counter, n_words: int, declared: float | None) -> list[float]:
    """Structure statistics of a whole text, each about 0 to 5."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    parts = np.bincount(_CLASS[raw], minlength=6) / n
    letters = max(1e-9, parts[0] + parts[1])
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(len(text)) / 4, math.log1p(n_words) / 3, min(5.0, len(text) / max(1, n_words) / 5),
        math.log1p(max(map(len, words), default=0)) / 2, parts[0] / letters if n_words else 0.0, parts[2] * 5,
        parts[3] * 5, parts[4] * 3, parts[5] * 2, len(words) / max(1, n_words),
        max(words.values(), default=0) / max(1, n_words), 1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n_words / max(1, len(lines))) / 3, min(5.0, 20 * text.count(".") / max(1, n_words)),
        math.log1p(max(0.0, declared if declared is not None else len(text))) / 4, 1.0,
    ]


class Features:
    """(indices, values) of a text: word buckets weighted by the sum of 1 + log of their words' counts, of unit length
    together, then the statistics."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        self.buckets = buckets
        self.cache: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
        return got

    def __call__(self, text: str | None, declared: float | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = Counter(text.split())
        n = sum(words.values())
        found = np.fromiter(map(self.bucket, words), np.int32, len(words))
        own = 1 + np.log(np.fromiter(words.values(), np.float32, len(words)))
        # words that share a bucket are one feature, so that no feature meets itself in the pairs
        idx, place = np.unique(found, return_inverse=True)
        val = np.bincount(place, own, len(idx))
        val = val / max(1e-9, float(np.sqrt((val * val).sum())))
        stats = np.array(statistics(text, words, n, declared), np.float32)
        at = np.arange(self.buckets, self.buckets + len(STATS), dtype=np.int32)
        return np.concatenate((idx, at)), np.concatenate((val.astype(np.float32), stats))


@dataclass
class Machine:
    """w0 + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), through the logistic function."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, idx: np.ndarray, val: np.ndarray) -> float:
        vx = self.v[idx] * val[:, None]
        total = vx.sum(axis=0)
        return float(self.w0 + self.w[idx] @ val + 0.5 * (total @ total - (vx * vx).sum()))

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.margin(idx, val)))))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, rank: int = RANK, epochs: int = 12,
    rate: float = 0.08, decay: float = 1e-5, batch: int = 64, seed: int = 7,
) -> Machine:
    """AdaGrad on the logistic loss. Without rows the machine scores everything 1/2."""
    size = buckets + len(STATS)
    rng = np.random.default_rng(seed)
    w0, g0 = 0.0, 1e-6
    w, gw = np.zeros(size, np.float32), np.full(size, 1e-6, np.float32)
    v = rng.normal(0, 0.02, (size, rank)).astype(np.float32)
    gv = np.full((size, rank), 1e-6, np.float32)
    if rows:
        share = min(0.99, max(0.01, sum(y for *_, y in rows) / len(rows)))
        w0 = math.log(share / (1 - share))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at:at + batch]]
            idx = np.concatenate([r[0] for r in part])
            val = np.concatenate([r[1] for r in part])
            cut = np.cumsum([0, *(len(r[0]) for r in part[:-1])])
            own = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
            y = np.array([r[2] for r in part], np.float32)
            vx = v[idx] * val[:, None]
            total = np.add.reduceat(vx, cut, axis=0)
            squares = np.add.reduceat((vx * vx).sum(axis=1), cut)
            margin = w0 + np.add.reduceat(w[idx] * val, cut) + 0.5 * ((total * total).sum(axis=1) - squares)
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(part)
            used, inv = np.unique(idx, return_inverse=True)
            e = err[own] * val
            dw = np.bincount(inv, e, len(used)) + decay * w[used]
            dv = np.stack([np.bincount(inv, e * (total[own, f] - vx[:, f]), len(used)) for f in range(rank)], 1)
            dv += decay * v[used]
            d0 = float(err.sum())
            g0 += d0 * d0
            w0 -= rate * d0 / math.sqrt(g0)
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            gv[used] += dv * dv
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
    return Machine(float(w0), w, v)


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the key's text is a multiple of 5."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _inputs(docs: DataFrame, id_col: str, text_col: str, meta_col: str | None) -> DataFrame:
    meta = F.col(meta_col).cast("double") if meta_col and meta_col in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), meta.alias("meta"))


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", meta_col: str | None = "n_chars", values: int = SAMPLE_VALUES,
) -> Machine:
    """Fit on at most ``sample`` labelled keys outside the held-out fold, the first by a hash of the key.

    Keys with several labels count as 1 where any is; keys without a document, null keys and null
    labels teach nothing. What reaches the driver are sparse features, no texts: ``sample`` rows, of which the
    last go where the first have ``values`` values together. A very long text has one value for each bucket at most.
    Repeated rows teach as often as they occur; further columns, whatever their names, are not looked at.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__key")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
        .orderBy(F.xxhash64("__key"), "__key").limit(sample)
    )
    assert sample <= 100_000, "the chosen keys are broadcast"
    src = _inputs(docs, id_col, text_col, meta_col).join(F.broadcast(chosen), F.col("doc") == F.col("__key")).select(
        "doc", "text", "meta", "y")

    def run(batches):
        make = Features()
        for b in slices(batches):
            got = [make(t.as_py(), m.as_py()) for t, m in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())),
                 pa.array([g[1] for g in got], pa.list_(pa.float32())), b.column(3)],
                names=["doc", "idx", "val", "y"])

    kind = src.schema["doc"].dataType.simpleString()
    found = materialise(map_batches(src, run, f"doc {kind}, idx array<int>, val array<float>, y int"), "sample")
    order = Window.orderBy(F.xxhash64("doc"), "doc").rowsBetween(Window.unboundedPreceding, 0)
    sizes = found.groupBy("doc").agg(F.sum(F.size("idx")).alias("k"))  # a row for each key of the sample
    first = sizes.select("doc", F.sum("k").over(order).alias("upto")).where(F.col("upto") <= values)
    table = found.join(F.broadcast(first.select("doc")), "doc", "left_semi").toArrow()
    rows = sorted(
        (
            (str(d), i.values.to_numpy(), x.values.to_numpy(), int(y))  # views of the table, no copies
            for d, i, x, y in zip(table["doc"].to_pylist(), table["idx"], table["val"], table["y"].to_pylist())
        ),
        key=lambda r: (r[0], len(r[1]), r[1][:8].tolist(), r[3]),
    )
    rows = [r[1:] for r in rows]
    machine = fit(rows)
    del table, rows
    release()  # the driver keeps what it took for the sample otherwise
    return machine


def score_quality(
    docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text",
    meta_col: str | None = "n_chars", out: str = "quality_score",
) -> DataFrame:
    """``docs`` with the score as column ``out`` (double, 0 to 1; replaces one of that name).

    A narrow stage: every row passes one Python worker in bounded batches. Null and empty texts get the
    score of a text without words; null metadata counts as the text's own length; equal rows get equal
    scores; an empty table stays empty. Neither labels nor key, language or source are inputs.
    """
    rest = [c for c in docs.columns if c != out]
    src = docs.select(*rest, *[c.alias(f"__{n}") for n, c in (
        ("t", F.col(text_col)),
        ("m", F.col(meta_col).cast("double") if meta_col and meta_col in rest else F.lit(None).cast("double")))])
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))

    def run(batches):
        model, make = Machine(*shared.value), Features()
        for b in slices(batches):
            s = [model.score(*make(t.as_py(), m.as_py())) for t, m in zip(b.columns[-2], b.columns[-1])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(s, pa.float64())], names=[*rest, out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return map_batches(src, run, StructType([*src.schema.fields[:-2], StructField(out, DoubleType())]))


#: Least score of a document that stays.
KEEP = 0.3


def keep_good(docs: DataFrame, machine: Machine, least: float = KEEP) -> DataFrame:
    """Rows of ``docs`` that score ``least`` or more."""
    return score_quality(docs, machine, out="__quality").where(F.col("__quality") >= least).select(*docs.columns)


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract rows of op8."""
    scored = score_quality(docs.select("doc_id", "text", "n_chars"), train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= KEEP).cast("int").alias("predicted"))
