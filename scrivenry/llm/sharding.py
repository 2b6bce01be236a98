"""Sharding by weighted rendezvous hashing (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Equal rows that are numbered at once.
RUN = 1 << 16


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """-w / ln(u) with u uniform in (0, 1): the largest score owns the key in proportion to w."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard.cast("int")), 11)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    return -weight / F.ln(u)


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """struct(score, shard) of the shard that owns ``key`` among ``len(weights)`` shards."""
    ranked = F.transform(
        F.array(*[F.lit(float(w)) for w in weights]),
        lambda w, i: F.struct(_score(key, i, w).alias("score"), (-i).cast("int").alias("minus")),
    )
    best = F.array_max(ranked)
    return F.struct(best["score"].alias("score"), (-best["minus"]).alias("shard"))


def assign_shards(
    df: DataFrame,
    key_col: str = "doc_id",
    weights: list[float] | None = None,
    grown_weight: float = 1.0,
    prefix: str = "",
) -> DataFrame:
    """``df`` with ``<prefix>shard`` and ``<prefix>grown_shard`` (owner after one more shard).

    Only the key and the shard list decide, so the plan is a projection: no shuffle.
    The extra shard can only take rows into itself, because the other scores stay as
    they are. Null keys share the shard of the empty key; repeated keys share a shard;
    an empty table gives an empty table. Columns named alike in ``df`` are replaced.
    """
    weights = weights or [1.0] * 40
    if any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    own = rendezvous_shard(key, weights)
    more = _score(key, F.lit(len(weights)), F.lit(float(grown_weight)))
    tmp = "__rendezvous_owner"
    return (
        df.withColumn(tmp, own)
        .withColumn(f"{prefix}shard", F.col(f"{tmp}.shard"))
        .withColumn(
            f"{prefix}grown_shard",
            F.when(more > F.col(f"{tmp}.score"), F.lit(len(weights))).otherwise(F.col(f"{tmp}.shard")),
        )
        .drop(tmp)
    )


def number_slots(
    rows: DataFrame, shard_col: str, order_cols: list[str], n_shards: int, buckets: int = 256
) -> DataFrame:
    """Every row with ``slot``: gapless from 0 in its shard, in a fixed order.

    Equal rows are counted before any shuffle and come back in runs of RUN slots. A shard is cut into ``buckets`` by a hash
    of the ordering columns; rows are numbered inside (shard, bucket) and start at the
    sum of the earlier buckets, a table of at most ``n_shards * buckets`` rows, which
    bounds the broadcast whatever the input is.
    """
    cols = rows.columns
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn(
        "__bucket", F.pmod(F.xxhash64(*order_cols), F.lit(buckets)).cast("int")
    )
    totals = counted.groupBy(shard_col, "__bucket").agg(F.sum("__n").alias("__t"))
    before = Window.partitionBy(shard_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(shard_col).alias("__shard"), F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__start"),
    )
    inside = Window.partitionBy(shard_col, "__bucket").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = counted.withColumn("__at", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    assert n_shards * buckets <= 1 << 20, "the table of starts is broadcast"
    return (
        placed.join(
            F.broadcast(starts),
            (placed[shard_col] == starts["__shard"]) & (placed["__bucket"] == starts["__b"]),
        )
        .select(
            *cols, (F.col("__start") + F.col("__at")).alias("__first"), "__n",
            F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / RUN))).alias("__run"))
        .select(
            *cols,
            F.explode(F.sequence(
                F.col("__first") + F.col("__run") * RUN,
                F.col("__first") + F.least((F.col("__run") + 1) * RUN, F.col("__n")) - 1)).alias("slot"),
        )
    )


def op7(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Contract rows of op7: law ``key``; size is UTF-8 bytes (null text: none) plus 16."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + F.lit(16)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = assign_shards(narrow, "doc_id", [1.0] * n_shards)
    numbered = number_slots(placed, "shard", ["doc_id", "text_crc32", "size"], n_shards)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
