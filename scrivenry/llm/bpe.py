"""Byte-level BPE: global shuffle of distinct pre-tokens, ids joined back by position; decoding by table."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from scrivenry.llm.batches import bound_batches, map_batches, slices
from scrivenry.sources.tables import note_made

#: UTF-8 bytes of text after which a task closes a block of documents.
BLOCK_BYTES = 12 << 20
#: Ids that a block's documents are given out with at once (one document at least).
OUT_IDS = 1 << 20
#: Hash parts, at least, that the distinct words of a block are dealt to; twice the shuffle partitions, where those are many.
PARTS = 256
_CACHE: dict[str, object] = {}


def load_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token bytes, id) of a rank file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, filter(bytes.strip, f))]


def _once(name: str, make):
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = make()
    return _CACHE[name]


class WordEncoder:
    """Ids of one pre-token, by the ranks, as the tiktoken library merges them."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str) -> None:
        import tiktoken

        self.ranks = dict(ranks)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def __call__(self, word: bytes) -> list[int]:
        known = self.ranks.get(word)
        return [known] if known is not None else self.encoding._encode_single_piece(word)


def planes(values: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte of all of them: high bytes are mostly zero and pack well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").reshape(n)


def steps(numbers: np.ndarray) -> np.ndarray:
    """Ascending numbers as the first and the steps between them."""
    return np.diff(numbers.astype(np.int64), prepend=0)


def pack(words: list[bytes], numbers: np.ndarray) -> bytes:
    """A part of a block's vocabulary: lengths, the words' ascending numbers in the block, the words."""
    lens = np.fromiter(map(len, words), np.uint32, len(words))
    return zlib.compress(struct.pack("<I", len(words)) + planes(lens) + planes(steps(numbers)) + b"".join(words), 1)


def unpack(data: bytes) -> tuple[list[bytes], np.ndarray]:
    raw = zlib.decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    lens = from_planes(raw, n, 4)
    numbers = np.cumsum(from_planes(raw, n, 4 + 4 * n), dtype=np.int64)
    ends = np.cumsum(lens, dtype=np.int64) + 4 + 8 * n
    return [raw[e - k:e] for e, k in zip(ends.tolist(), lens.tolist())], numbers


def pack_ids(numbers: np.ndarray, ids: list[list[int]]) -> bytes:
    """The ids of a part's words: their numbers in the block, how many each has, all ids."""
    lens = np.fromiter(map(len, ids), np.uint32, len(ids))
    flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum()))
    return zlib.compress(struct.pack("<I", len(ids)) + planes(steps(numbers)) + planes(lens) + planes(flat), 1)


def unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    return (np.cumsum(from_planes(raw, n, 4), dtype=np.int64), from_planes(raw, n, 4 + 4 * n),
            from_planes(raw, (len(raw) - 4 - 8 * n) // 4, 4 + 8 * n))


def _explode(src: DataFrame, pattern: str, kind: str, n_parts: int) -> DataFrame:
    """Pre-tokens of every text with their positions, as blocks of rows.

    A block's distinct words are numbered; a document is the sequence of its words' numbers, so the
    position of a word is its place there. Rows: part -1 is a document (data: numbers), part 0
    and up is a part of the vocabulary of the block.
    """

    def run(batches):
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        task = TaskContext.get().partitionId()
        vocabulary: dict[str, int] = {}
        block = size = 0
        names = ["block", "part", "doc", "data"]
        doc_type = None

        def close():
            words = [w.encode("utf-8", "surrogatepass") for w in vocabulary]
            parts = np.fromiter((zlib.crc32(w) % n_parts for w in words), np.int32, len(words))
            order = np.argsort(parts, kind="stable")
            cuts = np.searchsorted(parts[order], np.arange(n_parts + 1))
            used = [p for p in range(n_parts) if cuts[p] < cuts[p + 1]]
            data = [
                pack([words[i] for i in order[cuts[p]:cuts[p + 1]]], order[cuts[p]:cuts[p + 1]]) for p in used
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + block] * len(used), pa.int64()), pa.array(used, pa.int32()),
                 pa.nulls(len(used), doc_type), pa.array(data, pa.binary())], names=names)

        for b in slices(batches, megabytes=4):
            doc_type = b.column(0).type
            data = []
            number = vocabulary.setdefault
            size += b.column(1).nbytes
            for t in b.column(1):
                words = find(t.as_py() or "")
                data.append(planes(np.fromiter([number(w, len(vocabulary)) for w in words], np.uint32, len(words))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + block] * len(data), pa.int64()), pa.array([-1] * len(data), pa.int32()),
                 b.column(0), pa.array(data, pa.binary())], names=names)
            if size >= BLOCK_BYTES:
                if vocabulary:
                    yield close()
                vocabulary, size, block = {}, 0, block + 1
        if vocabulary:
            yield close()

    return map_batches(src, run, f"block bigint, part int, doc {kind}, data binary")


def _digest(ranks: list[tuple[bytes, int]], pattern: str) -> str:
    """Name of the whole vocabulary and pattern, under which a worker keeps its encoder."""
    h = hashlib.sha256(pattern.encode())
    for token, i in ranks:
        h.update(struct.pack("<IQ", len(token), i) + token)
    return h.hexdigest()


def encode(
    docs: DataFrame, ranks: list[tuple[bytes, int]], pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, ids array<int>): one row for each input row. Null and empty texts have no ids.

    The words of all blocks are dealt by a hash to parts; in a part each distinct word is encoded
    once, whatever number of blocks hold it, and its ids go back to each block. Even a word that is
    a third of all text is one entry for each block. Documents wait in a table bucketed by block, so
    only vocabularies are shuffled, never texts. A block (about 12 MB of UTF-8, or one longer text) is
    what one task holds. The ranks are a vocabulary file and are broadcast.

    Repeated rows and null keys come back as often as they came in; an empty table gives no rows;
    other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = src.schema["doc"].dataType.simpleString()
    table = f"bpe_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _explode(src, pattern, kind, max(PARTS, 2 * buckets)).write.format("parquet").option("compression", "zstd").bucketBy(
        buckets, "block").saveAsTable(table)
    note_made(spark, "table", table)
    shared = spark.sparkContext.broadcast(ranks)
    name = _digest(ranks, pattern)

    def encode_parts(batches):
        encoder = _once(name, lambda: WordEncoder(shared.value, pattern))
        here, known = None, {}
        for b in batches:
            out = []
            for part, data in zip(b.column(1).to_pylist(), b.column(2)):
                if part != here:
                    here, known = part, {}
                words, numbers = unpack(data.as_py())
                ids = []
                for w in words:
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encoder(w)
                    ids.append(got)
                out.append(pack_ids(numbers, ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["block", "ids"])

    rows = spark.table(table)
    words = rows.where("part >= 0").select("block", "part", "data")
    encoded = map_batches(words.repartition("part").sortWithinPartitions("part"), encode_parts, "block bigint, ids binary")
    documents = rows.where("part < 0").select("block", "doc", "data")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [unpack_ids(x.as_py()) for x in right["ids"]]
        n = 1 + max((int(p[0][-1]) for p in parts), default=-1)
        size, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = 0
        for number, length, _ in parts:
            size[number] = length
            start[number] = at + np.cumsum(length, dtype=np.int64) - length
            at += int(length.sum())
        flat = np.concatenate([p[2] for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32)
        del parts

        def batch(docs: pa.ChunkedArray, values: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, values)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
            return pa.RecordBatch.from_arrays([docs.combine_chunks(), ids], names=["doc", "ids"])

        out, values, held, first = [], [], 0, 0
        for k, d in enumerate(left["data"]):
            raw = d.as_buffer()
            words = from_planes(raw, len(raw) // 4)
            n = size[words]
            total = int(n.sum())
            # the k-th id of the document lies at its word's start plus its place in the word
            shift = np.repeat(start[words] - (np.cumsum(n) - n), n)
            values.append(flat[shift + np.arange(total)])
            held += total
            if held >= OUT_IDS:
                out.append(batch(left["doc"].slice(first, k + 1 - first), values))
                values, held, first = [], 0, k + 1
        if values:
            out.append(batch(left["doc"].slice(first), values))
        kinds = pa.schema([("doc", left.schema.field("doc").type), ("ids", pa.list_(pa.int32()))])
        return pa.Table.from_batches([b.cast(kinds) for b in out], kinds)

    return documents.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(
        assemble, f"doc {kind}, ids array<int>")


def token_bytes(ranks: list[tuple[bytes, int]]) -> pa.Table:
    """(id, token) by id: the side of the join that every task holds. An id with two tokens is an error."""
    rows = sorted((i, t) for t, i in ranks)
    ids = np.array([i for i, _ in rows], np.int64)
    if (np.diff(ids) == 0).any():
        raise ValueError("an id has two tokens")
    return pa.table({"id": pa.array(ids), "token": pa.array([t for _, t in rows], pa.binary())})


def token_table(spark: SparkSession, ranks: list[tuple[bytes, int]]) -> DataFrame:
    """(id, token binary): the token-byte table."""
    return spark.createDataFrame(token_bytes(ranks), "id int, token binary")


def join_tokens(lists: pa.ListArray, table: pa.Table) -> pa.Array:
    """The bytes of each list of ids; null lists give null.

    The distinct ids are merged with the token-byte table once, their bytes go back to every
    position, and a list's bytes are the stretch of its positions.
    """
    codes = pc.dictionary_encode(lists.flatten())
    wanted = codes.dictionary.to_numpy(zero_copy_only=False)
    known = table["id"].to_numpy()
    at = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
    if codes.null_count or (len(wanted) and (not len(known) or (known[at] != wanted).any())):
        raise ValueError("an id has no token")
    found = table["token"].combine_chunks().take(pa.array(at, pa.int64())).take(codes.indices)
    offsets = np.frombuffer(found.buffers()[1] or b"\0" * 4, np.int32)[found.offset:found.offset + len(found) + 1]
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
    cuts = pa.array(offsets[ends] if len(offsets) else ends, pa.int32())
    valid = pa.array([x.is_valid for x in lists], pa.bool_())
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(lists), [valid.buffers()[1], cuts.buffers()[1], found.buffers()[2] or pa.py_buffer(b"")])


def decode(df: DataFrame, ranks: list[tuple[bytes, int]], ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids as column ``out`` (replaced where it exists).

    A map-side join: the token-byte table is as large as the vocabulary file, so it is broadcast, and
    the rows are not shuffled. Null ids give null, no ids give no bytes, and an id outside the table
    (or a null one) raises ValueError.
    """
    rest = [c for c in df.columns if c != out]
    src = df.select(*rest)
    at = rest.index(ids_col)
    shared = df.sparkSession.sparkContext.broadcast(token_bytes(ranks))

    def run(batches):
        for b in slices(batches, megabytes=4):
            yield pa.RecordBatch.from_arrays([*b.columns, join_tokens(b.column(at), shared.value)], names=[*rest, out])

    return map_batches(src, run, StructType([*src.schema.fields, StructField(out, BinaryType())]))


def digests(df: DataFrame, keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """(keys, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows."""
    return df.select(
        *keys, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3(docs: DataFrame) -> DataFrame:
    """Contract rows of op3."""
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digests(decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks)).withColumnRenamed("doc", "doc_id")
