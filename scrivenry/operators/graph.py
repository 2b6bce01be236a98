"""Connected components: in one bounded task, or by alternating minimum stars."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, functions as F

from scrivenry.sources.batches import RECORDS, map_batches
from scrivenry.sources.tables import materialise

#: Distinct links, and bytes of their nodes, that one task joins by itself (about 120 MB at 16 bytes a node); more go
#: through rounds over the cluster.
ONE_TASK_LINKS, ONE_TASK_BYTES = 500_000, 64 << 20
#: Types whose order in Arrow is Spark's.
SAME_ORDER = ("int", "bigint", "string", "binary")


def _joined(batches):
    """All links (u, v) -> (node, component), by a union-find in which the smaller root stays."""
    links = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if links is None:
        return
    u, v = (links.column(i).combine_chunks() for i in (0, 1))
    codes = pc.dictionary_encode(pa.concat_arrays([u, v]))
    order = pc.sort_indices(codes.dictionary)
    nodes = codes.dictionary.take(order)
    place = np.empty(len(nodes), np.int64)
    place[order.to_numpy()] = np.arange(len(nodes))
    ends = place[codes.indices.to_numpy()].reshape(2, -1)
    up = array("q", range(len(nodes)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for at in range(0, len(u), RECORDS):
        for a, b in zip(*ends[:, at:at + RECORDS].tolist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    for at in range(0, len(nodes), RECORDS):
        own = nodes.slice(at, RECORDS)
        least = nodes.take(pa.array([root(x) for x in range(at, at + len(own))], pa.int64()))
        yield pa.RecordBatch.from_arrays([own, least], names=["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int | None = None) -> DataFrame:
    """(a, b) links of any one orderable type -> (node, component), component the smallest node.

    Only nodes with a link to another node are returned; loops and nulls are ignored.
    Up to ``one_task`` distinct links (ONE_TASK_LINKS where None) are joined in one task, because a round costs
    the driver some twelve jobs, whatever the number of links. More links go through rounds until they are so few.
    Each round hangs every larger neighbour of a node on the node's smallest
    neighbour (large star), then every smaller one (small star); the number of rounds
    is logarithmic in the diameter. A star centre with many leaves is aggregated with a
    partial ``min``, and its leaves are joined back from a written table, so that both sides of
    that join are plain exchanges, which adaptive execution splits where a centre has very
    many leaves. No group is collected. Each round is written to the shared folder.
    """
    e = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    e = materialise(e, "links")
    kind = e.schema["u"].dataType.simpleString()
    most = ONE_TASK_LINKS if one_task is None else one_task
    size = F.octet_length("u") + F.octet_length("v") if kind in ("string", "binary") else F.lit(16)
    state = [F.count("*").alias("n"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("bytes")]

    def few(now: Row) -> bool:
        return kind in SAME_ORDER and now["n"] <= most and now["bytes"] <= ONE_TASK_BYTES

    def at_once(e: DataFrame) -> DataFrame:
        return materialise(map_batches(e.coalesce(1), _joined, f"node {kind}, component {kind}"), "components")

    if few(e.agg(*state).first()):
        return at_once(e)
    seen = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        nxt = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small_low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        e = materialise(nxt, "links")
        now = e.agg(
            *state, F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s"),
        ).first()
        if few(now):
            return at_once(e)
        if now == seen:
            return e.groupBy("u").agg(F.min("v").alias("m")).select(
                F.col("u").alias("node"), F.col("m").alias("component")
            ).union(e.select("v", "v").distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
