"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scrivenry.llm.batches import map_batches, slices
from scrivenry.operators.graph import connected_components
from scrivenry.sources.tables import materialise

#: Hash tables; rotations joined in a table's key; keys probed in a table (the key itself first).
TABLES = 10
ROTATIONS = 3
PROBES = 4
#: A bucket of more vectors is cut into blocks that meet pairwise.
BLOCK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two wide), orthonormal."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-random rotation H D3 H D2 H D1: three rounds of random signs and a transform."""
    signs = np.random.default_rng(seed).choice((-1.0, 1.0), (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def buckets(x: np.ndarray, table: int, rotations: int, probes: int) -> np.ndarray:
    """(rows, probes) keys in ``table``: the nearest signed axis of every rotation; further probes
    exchange one rotation's axis for its next best, the smallest loss first."""
    n = len(x)
    best, second, loss = [], [], []
    for r in range(rotations):
        y = rotate(x, 1_000_003 * table + r)
        order = np.argpartition(-np.abs(y), 2, axis=1)[:, :3]
        size = np.take_along_axis(np.abs(y), order, 1)
        rank = np.argsort(-size, axis=1, kind="stable")
        order, size = np.take_along_axis(order, rank, 1), np.take_along_axis(size, rank, 1)
        code = 2 * order + (np.take_along_axis(y, order, 1) < 0)
        best.append(code[:, 0])
        for k in (1, 2):
            second.append((r, code[:, k]))
            loss.append(size[:, 0] - size[:, k])
    base = np.array(best, np.int64)
    width = 2 * x.shape[1]
    weights = width ** np.arange(rotations, dtype=np.int64)
    key = weights @ base
    out = [key]
    if probes > 1:
        order = np.argsort(np.array(loss), axis=0, kind="stable")
        other = np.array([key + (c - base[r]) * weights[r] for r, c in second])
        out += [np.take_along_axis(other, order[i:i + 1], 0)[0] for i in range(min(probes - 1, len(second)))]
    return np.stack(out, 1) * 1024 + table


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length; scaled first, so that no finite row overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the vectors that can link: no null or non-finite part, not zero."""
    v = F.col(vec_col).cast("array<double>")
    inf = float("inf")
    good = F.col("vec").isNotNull() & F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (x < F.lit(inf)) & (x > F.lit(-inf))
    ) & F.exists("vec", lambda x: x != 0)
    return df.select(F.col(id_col).alias("id"), v.alias("vec")).where(good)


def _deal(vectors: DataFrame, tables: int, rotations: int, probes: int, block: int) -> DataFrame:
    """(dim, key, i, j, side, id, n, keys, vec): the members of every two blocks that meet, in sorted partitions.

    Vectors of one length meet only each other. Every vector enters ``probes`` buckets in each of
    ``tables`` tables. A bucket of more than ``block`` vectors is cut by a hash into blocks and each two
    blocks are a group of their own, so no pair of a bucket is left out and a group stays bounded.
    """
    def hashed(batches):
        for b in slices(batches):
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x = _matrix(part.column(1), int(dim))
                padded = 1 << max(2, (int(dim) - 1).bit_length())
                x = np.pad(x, ((0, 0), (0, padded - int(dim))))
                keys = np.concatenate([buckets(x, t, rotations, probes) for t in range(tables)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(list(keys), pa.list_(pa.int64()))], names=["id", "dim", "keys"])

    sized = vectors.withColumn("dim", F.size("vec"))
    keyed = materialise(map_batches(sized.select("id", "vec", "dim"), hashed, "id bigint, dim int, keys array<bigint>"), "buckets")
    routed = keyed.select("id", "dim", F.explode(F.array_distinct("keys")).alias("key"))
    big = routed.groupBy("dim", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(
        "dim", "key", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    cut = routed.join(big, ["dim", "key"]).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = cut.select(
        "dim", "key", "side", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("dim", "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id")
    # only members of shared buckets take their vector along
    whole = sized.select("id", "n", "vec").join(keyed.select("id", "keys"), "id")
    met = dealt.join(whole, "id").select("dim", "key", "i", "j", "side", "id", "n", "keys", "vec")
    return met.repartition("dim", "key", "i", "j").sortWithinPartitions("dim", "key", "i", "j")


class _Group:
    """Members of one group: which are linked, and which links no earlier group has."""

    def __init__(self, at: tuple, held: list[tuple], threshold: float, tables: int) -> None:
        side, self.ids, self.n, self.keys, x = (np.concatenate([h[i] for h in held]) for i in range(5))
        self.same = at[2] == at[3]
        self.left = np.arange(len(side)) if self.same else np.flatnonzero(side == at[2])
        self.right = self.left if self.same else np.flatnonzero(side == at[3])
        self.key, self.table = at[1], at[1] % 1024
        y = x[self.right]
        self.linked = np.zeros((len(self.left), len(self.right)), bool)
        for s in range(0, len(self.left), 256):
            cos = x[self.left[s:s + 256]] @ y.T
            self.linked[s:s + 256] = cos >= threshold
            edge = np.abs(cos - threshold) < 1e-9
            if edge.any():
                p, q = np.nonzero(edge)
                self.linked[s + p, q] = np.einsum("ij,ij->i", x[self.left[s + p]], y[q]) >= threshold
        if self.same:
            np.fill_diagonal(self.linked, False)
        self.probes = self.keys.shape[1] // tables

    def new_pairs(self):
        """Links (left place, right place) of which this group's key is the smallest shared one in the first table
        that shares any, so a pair is new in one group alone. In slices."""
        rows, cols = np.nonzero(np.triu(self.linked) if self.same else self.linked)
        w, n = self.probes, self.table + 1
        for s in range(0, len(rows), 1 << 13):
            p, q = self.left[rows[s:s + (1 << 13)]], self.right[cols[s:s + (1 << 13)]]
            a, b = (self.keys[x, :n * w].reshape(-1, n, w) for x in (p, q))
            met = (a[:, :, :, None] == b[:, :, None, :]).any(3)
            shared = np.where(met[:, -1], a[:, -1], np.iinfo(np.int64).max).min(1)
            own = ~met[:, :-1].any((1, 2)) & (shared == self.key)
            yield p[own], q[own]

    def tree(self) -> list[tuple[int, int]]:
        """Links that join all that the group's links join, one less than their members."""
        out = []
        m = len(self.left)
        if self.same:
            rest = np.ones(m, bool)
            for root in range(m):
                if not rest[root]:
                    continue
                rest[root] = False
                todo = [root]
                while todo:
                    at = todo.pop()
                    found = np.flatnonzero(self.linked[at] & rest)
                    rest[found] = False
                    out += [(at, k) for k in found.tolist()]
                    todo += found.tolist()
            return [(int(self.ids[self.left[a]]), int(self.ids[self.left[b]])) for a, b in out]
        rest_l, rest_r = np.ones(m, bool), np.ones(len(self.right), bool)
        for root in range(m):
            if not rest_l[root]:
                continue
            rest_l[root] = False
            todo = [(0, root)]
            while todo:
                side, at = todo.pop()
                rest = rest_l if side else rest_r
                found = np.flatnonzero((self.linked[:, at] if side else self.linked[at]) & rest)
                rest[found] = False
                out += [(k, at) if side else (at, k) for k in found.tolist()]
                todo += [(1 - side, k) for k in found.tolist()]
        return [(int(self.ids[self.left[a]]), int(self.ids[self.right[b]])) for a, b in out]


def _groups(batches, threshold: float, tables: int):
    """Groups with a link, of sorted rows (dim, key, i, j, side, id, n, keys, vec)."""
    here, held = None, []

    def close():
        if here is None or sum(len(h[1]) for h in held) < 2:
            return None
        sides = np.concatenate([h[0] for h in held])
        if here[2] != here[3] and not ((sides == here[2]).any() and (sides == here[3]).any()):
            return None
        found = _Group(here, held, threshold, tables)
        return found if found.linked.any() else None

    for b in slices(batches):
        dim, k, i, j, side, ids, n = (b.column(c).to_numpy(zero_copy_only=False) for c in range(7))
        edge = np.flatnonzero((np.diff(dim) != 0) | (np.diff(k) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        for s, e in zip((0, *edge), (*edge, len(k))):
            now = (int(dim[s]), int(k[s]), int(i[s]), int(j[s]))
            if now != here:
                if (got := close()) is not None:
                    yield got
                here, held = now, []
            keys = b.column(7).slice(s, e - s).flatten().to_numpy().reshape(e - s, -1)
            held.append((side[s:e], ids[s:e], n[s:e], keys, _matrix(b.column(8).slice(s, e - s), now[0])))
    if (got := close()) is not None:
        yield got


def near_pairs(
    vectors: DataFrame, dim: int, threshold: float = 0.9, tables: int = TABLES, rotations: int = ROTATIONS,
    probes: int = PROBES, block: int = BLOCK,
) -> DataFrame:
    """(id, vec) of distinct ids -> (a, b), a < b: every link of vectors of length ``dim`` once.

    The members of a bucket are compared exactly in double precision. What is lost are pairs that share
    no bucket. A group of m near vectors has m * (m - 1) / 2 rows here; ``near_links`` has none of them.
    """
    def run(batches):
        for g in _groups(batches, threshold, tables):
            for p, q in g.new_pairs():
                a, b = g.ids[p], g.ids[q]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    rows = vectors.where(F.size("vec") == dim).withColumn("n", F.lit(1).cast("bigint"))
    return map_batches(_deal(rows, tables, rotations, probes, block), run, "a bigint, b bigint")


def near_links(
    vectors: DataFrame, threshold: float = 0.9, tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES,
    block: int = BLOCK,
) -> DataFrame:
    """(id, n, vec) of distinct ids -> rows (a, b, linked): b null: ``linked`` vectors more that link with a
    (the sum of their n); else a link of a spanning set.

    A link is counted in the one group that has the first bucket its vectors share, so pairs never
    leave their group: rows out are bounded by the members of groups, not by their square.
    """
    def run(batches):
        for g in _groups(batches, threshold, tables):
            total = np.zeros(len(g.ids), np.int64)
            for p, q in g.new_pairs():
                np.add.at(total, p, g.n[q])
                np.add.at(total, q, g.n[p])
            some = np.flatnonzero(total)
            tree = np.array(g.tree(), np.int64).reshape(-1, 2)
            a = np.concatenate((g.ids[some], tree[:, 0]))
            b = pa.array(np.concatenate((np.zeros(len(some), np.int64), tree[:, 1])), mask=np.arange(len(a)) < len(some))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), b, pa.array(np.concatenate((total[some], np.zeros(len(tree), np.int64))))], names=["a", "b", "linked"])

    return map_batches(_deal(vectors, tables, rotations, probes, block), run, "a bigint, b bigint, linked bigint")


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, **how
) -> DataFrame:
    """(id, n_links, component, kept): one row for each input row.

    Equal vectors are one node with a count, so copies are never paired with each other. Vectors of
    different lengths do not link; each length is searched in its own buckets. Vectors that are null,
    zero or hold null or non-finite parts link with nothing and are kept as classes of their own. A
    repeated id has one class: its vectors' links are summed. An empty table gives no rows; further
    columns, whatever their names, are not looked at.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    good = _clean(rows, "id", "v")
    copies = materialise(
        good.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("id is not null"), "vectors")
    found = materialise(near_links(copies, threshold, **how), "links-of-vectors")
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("linked").alias("linked"))
    joined = connected_components(found.where("b is not null").select("a", "b"))
    nodes = (
        copies.join(links, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select("vec", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component"))
    )
    out = (
        rows.withColumn("vec", F.col("v").cast("array<double>")).drop("v").join(nodes, "vec", "left")
        .select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def op5(vectors: DataFrame) -> DataFrame:
    """Contract rows of op5."""
    return near_duplicates(vectors).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
