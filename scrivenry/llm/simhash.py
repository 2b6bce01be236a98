"""SimHash near-duplicates: fingerprints, sharded BK-trees, components of links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scrivenry.llm.batches import map_batches, slices
from scrivenry.operators.graph import connected_components
from scrivenry.sources.tables import materialise

#: A shard with more fingerprints than this is cut into blocks; trees of blocks meet pairwise.
BLOCK = 4096
#: The same for shards by min-wise shingles, whose fingerprints are wide.
WIDE_BLOCK = 1024
#: A class of candidates with more nodes, or more shingles in all, is cut into blocks likewise.
VERIFY_BLOCK, VERIFY_SHINGLES = 4096, 2_000_000
#: Hashes turned into bit counts at once.
CHUNK = 8192


class BKTree:
    """Metric tree over integers: a child's key is its Hamming distance to the parent."""

    __slots__ = ("root", "children")

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = x
            self.children[x] = {}
            return
        at = self.root
        while at != x:
            d = (at ^ x).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = x
                self.children[x] = {}
                return
            at = nxt

    def within(self, x: int, radius: int) -> Iterator[int]:
        """Members at most ``radius`` bits from ``x``; only edges within the radius are followed."""
        todo = [] if self.root is None else [self.root]
        while todo:
            at = todo.pop()
            d = (at ^ x).bit_count()
            if d <= radius:
                yield at
            edges = self.children[at]
            if len(edges) <= 2 * radius + 1:
                todo.extend(c for k, c in edges.items() if d - radius <= k <= d + radius)
            else:
                todo.extend(edges[k] for k in range(d - radius, d + radius + 1) if k in edges)


def shingle_hashes(text: str | None, k: int):
    """XXH64 (seed 42) of every k-word shingle, A-Z lower-cased, words parted by ASCII white space."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - k + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(k, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n
    )


def fingerprint(hashes, words: int = 1) -> bytes:
    """Big-endian SimHash of 64 * ``words`` bits: a bit is 1 if set in over half the hashes.

    The first word takes the hashes as they are; each further one takes them multiplied by an
    odd constant and folded.
    """
    import numpy as np

    out = []
    for w in range(words):
        h = hashes
        if w:
            h = h * np.uint64((0x9E3779B97F4A7C15 * (2 * w + 1)) % 2**64)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        count = np.zeros(64, np.int64)
        for i in range(0, len(h), CHUNK):
            bits = np.unpackbits(h[i:i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            count += bits.sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * count > len(h)).tobytes())
    return b"".join(out)


def anchors(hashes, n: int):
    """``n`` min-wise shingles: for each of n mixings of the hashes the smallest value (0 without shingles)."""
    import numpy as np

    if not len(hashes):
        return [0] * n
    out = []
    for i in range(n):
        # mixed twice: products by small multiples of one number are small together, and so are their minima
        h = hashes ^ np.uint64((0xD6E8FEB86659FD93 * (2 * i + 3)) % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(int((h ^ (h >> np.uint64(31))).min()) & (2**63 - 1))
    return out


def fingerprints(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int, n_anchors: int, sets: bool = False
) -> DataFrame:
    """(doc, fp binary, anchors array<bigint>) for every row; the text never leaves its task.

    With ``sets`` the fingerprint is of the set of shingles, however often each occurs, and ``node``
    (128-bit digest of the set) and ``n`` (its size) are added.
    """
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = src.schema["doc"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import xxhash

        for b in slices(batches, megabytes=4):
            fps, anc, nodes, sizes = [], [], [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), shingle)
                if sets:
                    h = np.unique(h)
                    nodes.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sizes.append(len(h))
                fps.append(fingerprint(h, words))
                anc.append(anchors(h, n_anchors))
            cols = [b.column(0), pa.array(fps, pa.binary()), pa.array(anc, pa.list_(pa.int64()))]
            if sets:
                cols += [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "fp", "anchors", "node", "n"][:len(cols)])

    return map_batches(src, run, f"doc {kind}, fp binary, anchors array<bigint>" + (", node binary, n bigint" if sets else ""))


def _band_keys(fp: Column, radius: int) -> Column:
    """Shards of a 64-bit fingerprint: bands of bits such that two fingerprints within ``radius``
    share a shard for certain. Of radius + 4 bands they agree on 4 at least; every 4 bands are a key."""
    n = radius + 4
    value = F.conv(F.hex(fp), 16, -10).cast("bigint")
    cuts = [64 * i // n for i in range(n + 1)]
    keys = []
    for bands in combinations(range(n), 4):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in bands)
        mask -= 1 << 64 if mask >> 63 else 0
        keys.append(F.xxhash64(F.lit(len(keys)), value.bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def _anchor_keys(anc: Column, n: int) -> Column:
    """Shards of a document: every two of its min-wise shingles."""
    return F.array(*[
        F.xxhash64(F.lit(i * n + j), anc[i], anc[j]) for i, j in combinations(range(n), 2)
    ])


class _Classes:
    """Classes of the members of a group, and how many there are."""

    def __init__(self) -> None:
        self.parent: dict = {}
        self.count = 0

    def add(self, x) -> None:
        self.parent[x] = x
        self.count += 1

    def root(self, x):
        up = self.parent
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x, y) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.parent[a] = b
        self.count -= 1
        return True


def _join_blocks(radius: int):
    """Groups (key, i, j) in sorted rows -> links (a, b) of fingerprints that span the near ones.

    Where all members of a tree are one class, a search ends at its first hit, so copies of one text with
    small changes cost a search each and not all their pairs. A group of two blocks gives out only links
    that join what the blocks do not join by themselves, which their own groups give out.
    """

    def grow(members: list[int], out: list[tuple[int, int]]) -> tuple[BKTree, _Classes]:
        tree, classes = BKTree(), _Classes()
        for x in members:
            classes.add(x)
            for y in tree.within(x, radius):
                if classes.join(x, y):
                    out.append((x, y))
                if classes.count == 1:
                    break
            tree.add(x)
        return tree, classes

    def group(left: list[int], right: list[int], same: bool, width: int, out: list[tuple[bytes, bytes]]) -> None:
        found: list[tuple[int, int]] = []
        tree, classes = grow(left, found)
        if not same:
            found = []
            one = classes.count == 1
            others = grow(right, [])[1]
            classes.parent |= others.parent
            classes.count += others.count
            for x in right:
                if one and classes.root(x) == classes.root(left[0]):
                    continue
                for y in tree.within(x, radius):
                    if classes.join(x, y):
                        found.append((x, y))
                    if one or classes.count == 1:
                        break
                if classes.count == 1:
                    break
        out += [(x.to_bytes(width), y.to_bytes(width)) for x, y in found]

    def run(batches):
        here = None
        left: list[int] = []
        right: list[int] = []
        out: list[tuple[bytes, bytes]] = []
        width = 8

        def close() -> None:
            if here is not None and (len(left) > 1 if here[1] == here[2] else left and right):
                group(left, right, here[1] == here[2], width, out)

        for b in batches:
            for key, i, j, side, fp in zip(*(c.to_pylist() for c in b.columns)):
                if here != (key, i, j):
                    close()
                    here, left, right, width = (key, i, j), [], [], len(fp)
                (left if side == i else right).append(int.from_bytes(fp))
            if len(out) >= 10_000:
                yield _pairs(out)
                out.clear()
        close()
        yield _pairs(out)

    return run


def _pairs(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"]
    )


def near_links(routed: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(key, fp) rows, distinct -> links (a, b) that join all fingerprints of a shard within ``radius``.

    A shard's tree is built in the task that its fingerprints are dealt to. A shard of more than
    ``block`` fingerprints is cut by a hash into blocks, and each two blocks become one group: the
    tree of one, searched for the members of the other. So a group never holds more than about
    twice ``block`` members, whatever a shard holds, and no pair of a shard is left out.
    """
    big = routed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(
        "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # shards of one member have nothing to link
    cut = routed.join(big, "key").withColumn("side", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = cut.select(
        "key", "side", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "fp")
    return map_batches(
        dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), _join_blocks(radius), "a binary, b binary")


def _shingle_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``members`` (doc, key, blocks, side, fp, node) with ``set``: the sorted hashes of the shingles as bytes."""
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    src = members.join(texts, members["doc"].eqNullSafe(texts["__id"])).select("key", "blocks", "side", "fp", "node", "text")

    def run(batches):
        import numpy as np
        import xxhash

        for b in slices(batches, megabytes=4):
            found = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in b.column(5)]
            # rows may share an id; only a row with the node's own set stands for it
            own = pa.array([xxhash.xxh3_128_digest(x) == n.as_py() for x, n in zip(found, b.column(4))], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(found, pa.binary())], names=["key", "blocks", "side", "fp", "node", "set"]).filter(own)

    kind = src.schema["key"].dataType.simpleString()
    return map_batches(src, run, f"key {kind}, blocks int, side int, fp binary, node binary, set binary")


def _verify_blocks(similarity: float, radius: int):
    """Groups (key, i, j) in sorted rows -> links (a, b) of nodes that span those of ``similarity`` or more; as ``_join_blocks``."""

    def near(a: tuple, b: tuple) -> bool:
        import numpy as np

        (fa, sa), (fb, sb) = a, b
        small, large = sorted((len(sa), len(sb)))
        if small < similarity * large - 1 or (fa ^ fb).bit_count() > radius:
            return False
        both = np.concatenate((sa, sb))
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return bool(shared) and shared / (len(both) - shared) >= similarity

    def grow(members: dict, out: list[tuple[bytes, bytes]]) -> _Classes:
        classes, earlier = _Classes(), []
        for x, own in members.items():
            classes.add(x)
            for y in earlier:
                if classes.root(x) != classes.root(y) and near(own, members[y]):
                    classes.join(x, y)
                    out.append((x, y))
                if classes.count == 1:
                    break
            earlier.append(x)
        return classes

    def group(left: dict, right: dict, out: list[tuple[bytes, bytes]]) -> None:
        if not right:
            grow(left, out)
            return
        classes, others = grow(left, []), grow(right, [])
        classes.parent |= others.parent
        classes.count += others.count
        for x, own in right.items():
            for y, other in left.items():
                if classes.count == 1:
                    return
                if classes.root(x) != classes.root(y) and near(own, other):
                    classes.join(x, y)
                    out.append((x, y))

    def run(batches):
        import numpy as np

        here = None
        left: dict = {}
        right: dict = {}
        out: list[tuple[bytes, bytes]] = []

        def close() -> None:
            if here is not None and left and (right or here[1] == here[2]):
                group(left, right, out)

        for b in batches:
            for key, i, j, side, fp, node, hashes in zip(*(c.to_pylist() for c in b.columns)):
                if here != (key, i, j):
                    close()
                    here, left, right = (key, i, j), {}, {}
                (left if side == i else right)[node] = (int.from_bytes(fp), np.frombuffer(hashes, np.uint64))
            if len(out) >= 10_000:
                yield _pairs(out)
                out.clear()
        close()
        yield _pairs(out)

    return run


def verified_links(
    docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, radius: int,
    block: int = VERIFY_BLOCK, weight: int = VERIFY_SHINGLES,
) -> DataFrame:
    """Links (a, b) that join all nodes of a class within ``radius`` whose sets have a Jaccard similarity of ``similarity``.

    ``nodes`` has (doc, node, fp, n, class). Only the sets of classes of several nodes are made, one for
    each node, and compared exactly (64-bit hashes stand for shingles). A class of more than ``block``
    nodes or ``weight`` shingles is cut into blocks that meet pairwise, so no pair of it is left out.
    """
    big = nodes.groupBy("class").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")).where("m > 1").select(
        F.col("class").alias("key"), F.ceil(F.greatest(F.col("m") / block, F.col("w") / weight)).cast("int").alias("blocks"))
    members = nodes.join(big, nodes["class"] == big["key"]).select(
        "doc", "key", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("side"), "fp", "node")
    sets = _shingle_sets(docs, members, id_col, text_col, shingle)
    dealt = sets.select("key", "side", "fp", "node", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "fp", "node", "set")
    return map_batches(
        met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), _verify_blocks(similarity, radius), "a binary, b binary")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1,
    radius: int = 2, n_anchors: int = 0, similarity: float | None = None,
) -> DataFrame:
    """(doc, fp, component): one row for each input row; component is the smallest id reachable.

    Documents link where their SimHashes over ``shingle``-word shingles differ in at most ``radius``
    of 64 * ``words`` bits. Equal fingerprints are one node, so copies cost nothing. Without anchors
    (64 bits) shards are bands of the fingerprint and no link is lost. With ``n_anchors`` min-wise
    shingles, shards are pairs of them, for radii where bands are too short: two documents of
    similarity s miss each other when fewer than two anchors agree (0.01 % at 0.8 and 8 anchors).
    Trees grow with the corpus, so they are not broadcast whole: each shard's tree meets only the
    fingerprints routed to it.

    With ``similarity`` the classes so found are only candidates: fingerprints are of sets of shingles, and
    within a class two documents link only where the exact Jaccard similarity of their sets is that high.

    Texts without words (null, empty) have fingerprint zero and link like any other. A null id
    counts as a document but never names a component unless nothing else does. Repeated rows come
    back as often as they came in; an empty table gives no rows; other columns are not looked at.
    """
    if not n_anchors and words != 1:
        raise ValueError("bands cut a fingerprint of 64 bits")
    exact = similarity is not None
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, words, n_anchors, exact), "fingerprints")
    # a number for a fingerprint: its own bits, or of wide ones a hash
    number = (lambda fp: F.conv(F.hex(fp), 16, -10).cast("bigint")) if words == 1 else F.xxhash64
    nodes = prints.groupBy("fp").agg(F.min("doc").alias("doc")).withColumn("at", number(F.col("fp")))
    if n_anchors:
        routed = prints.select(F.explode(_anchor_keys(F.col("anchors"), n_anchors)).alias("key"), "fp").distinct()
    else:
        routed = nodes.select(F.explode(_band_keys(F.col("fp"), radius)).alias("key"), "fp")
    links = near_links(routed, radius, WIDE_BLOCK if n_anchors else BLOCK).select(number(F.col("a")).alias("a"), number(F.col("b")).alias("b"))
    joined = connected_components(links)
    classes = nodes.join(joined, nodes["at"] == joined["node"], "left").select("fp", "at", "doc", F.coalesce("component", "at").alias("class"))
    if exact:
        own = prints.groupBy("node").agg(*[F.min(c).alias(c) for c in ("doc", "fp", "n")]).withColumn("at", number(F.col("fp")))
        members = materialise(own.join(classes.select("at", "class"), "at").select("doc", "node", "fp", "n", "class"), "candidates")
        links = verified_links(docs, members, id_col, text_col, shingle, similarity, radius)
        joined = connected_components(links).withColumnRenamed("node", "at")
        classes = members.join(joined, members["node"] == joined["at"], "left").select(
            "node", "doc", F.coalesce("component", "node").alias("class"))
        least = classes.groupBy("class").agg(F.min("doc").alias("component"))
        named = classes.select("node", "class").join(least, "class").select("node", "component")
        return prints.select("doc", "fp", "node").join(named, "node").select("doc", "fp", "component")
    least = classes.groupBy("class").agg(F.min("doc").alias("component"))
    named = classes.select("fp", "class").join(least, "class").select("fp", "component")
    return prints.select("doc", "fp").join(named, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of ``docs`` that are the first of their group: the smallest id, null ids last.

    Rows are told apart by their place in the scan, so of repeated rows one stays; ``docs`` must be a
    scan that can be repeated, as a table of files is.
    """
    row = "__simhash_row"
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    found = near_duplicates(placed.withColumn("__rank", rank), "__rank", text_col, **how)
    first = found.where(F.col("doc") == F.col("component")).select(F.col("doc.row").alias("__first"))
    return placed.join(first, F.col(row) == F.col("__first"), "left_semi").select(*docs.columns)


def op10(docs: DataFrame) -> DataFrame:
    """Contract rows of op10."""
    return near_duplicates(docs).select(
        F.col("doc").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
