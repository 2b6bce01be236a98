"""Token-id files: length-delimited, checksummed binary records and an offset index."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from scrivenry.llm.batches import map_batches, slices
from scrivenry.sources.tables import shared_dir

#: Fixed values of the record format (all numbers little-endian).
#:   record  = length u64 | masked crc32 of these 8 bytes u32 | payload | masked crc32 of payload u32 | 0x0A
#:   payload = 1 if the key is set, else 0, u8 | key i64 | bytes of an id u8 | ids
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
FOOT = struct.Struct("<I")
INNER = struct.Struct("<BqB")

_TOKENIZERS: dict[str, tuple] = {}
#: Text bytes of a shard (a range of keys); bytes of records that are written as one row, and rows of a file.
SHARD_BYTES, BLOB_BYTES, FILE_BLOBS = 32 << 20, 4 << 20, 4
#: Words, and ids of all of them, that a Python worker remembers, and ids of a word that is kept when these are full;
#: a batch's own are always held.
MAX_WORDS, MAX_IDS, KEPT_IDS = 500_000, 16_000_000, 32
END_MARK = re.compile(r"([.,!?;:])(?<=[^\W_][.,!?;:])(?![^ \n])")
ODD = ("\u03a3", "\u0130", "<|")
#: The tokenizer whose words are cut here, and its pattern for words of characters that composition and lower case
#: leave alone (Latin-1 but for capitals and white space), with the classes written out.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
PLAIN = re.compile(r"[!-@\[-~\xa1-\xbf\xd7\xdf-\xff]+")
_L, _N = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_L}{_N}]+")


def masked_crc(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant, so that a checksum of checksums is not weak."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(key: int | None, ids: bytes, width: int) -> bytes:
    payload = INNER.pack(key is not None, key or 0, width) + ids
    size = struct.pack("<Q", len(payload))
    return size + FOOT.pack(masked_crc(size)) + payload + FOOT.pack(masked_crc(payload))


def read_frames(content):
    """(offset, length, key, ids) of every record of a file; raises ValueError on any damage."""
    view = memoryview(content)
    at, whole = 0, len(view)
    fixed, least = HEAD.size, HEAD.size + FOOT.size + 1
    while at < whole:
        if at + least > whole:
            raise ValueError(f"cut short at {at}")
        size, check = HEAD.unpack_from(view, at)
        begin = at + fixed
        end = begin + size + FOOT.size
        if masked_crc(view[at:at + 8]) != check or end >= whole:
            raise ValueError(f"bad length at {at}")
        payload = view[begin:begin + size]
        if masked_crc(payload) != FOOT.unpack_from(view, begin + size)[0] or view[end] != 10:
            raise ValueError(f"bad record at {at}")
        known, key, width = INNER.unpack_from(payload)
        yield at, end + 1 - at, key if known else None, np.frombuffer(payload, "<u2" if width == 2 else "<u4", -1, INNER.size)
        at = end + 1


class ChunkEncoder:
    """The tokenizers library over pieces between spaces and line feeds, each distinct piece once.

    Only for tokenizers whose pre-tokenisation drops white space and never joins across it, so that
    the ids of a text are those of its pieces in turn. Where the tokenizer lower-cases, pieces meet in
    lower case, and one end mark after a letter or digit, where the tokenizer parts it, is a piece of
    its own. Pieces are numbered: a batch's are parted and told apart by Arrow, and only distinct ones
    pass through Python. The memory is bounded; what falls out is encoded again.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        known = json.loads(spec)
        kinds = {x["type"] for x in (known.get("normalizer") or {}).get("normalizers", ())}
        self.folds = "Lowercase" in kinds
        parts = [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("a.")] if self.tokenizer.pre_tokenizer else []
        self.parts = len(parts) == 2
        suffix = known["model"].get("end_of_word_suffix")
        self.last = None
        if suffix and self.parts:
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        #: The same model without what plain words need not: they are normal already, and cut as it cuts them.
        self.bare = None
        if self.last is not None and known["normalizer"] == NORMALIZER and known["pre_tokenizer"] == PRE_TOKENIZER:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, f"<u{self.width}")
        self.begin, self.size, self.hits = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0

    def _append(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Number words that are not known, ``ids`` being theirs in turn."""
        at, end = len(self.words), len(self.words) + len(words)
        self.words.update(zip(words, range(at, end)))
        for name in ("begin", "size", "hits"):
            if end > len(getattr(self, name)):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(end, getattr(self, name).dtype)]))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(ids), self.flat.dtype)])
        self.begin[at:end] = self.used + np.cumsum(sizes) - sizes
        self.size[at:end], self.hits[at:end] = sizes, 0
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def _gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of these numbers in turn, and where each word's end."""
        sizes = self.size[index]
        ends = np.cumsum(sizes)
        out = np.empty(ends[-1] if len(ends) else 0, self.flat.dtype)
        at = 0
        for k in range(0, len(index), 1 << 18):
            part = slice(k, k + (1 << 18))
            places = np.repeat(self.begin[index[part]] - ends[part] + sizes[part], sizes[part])
            places += np.arange(at, at + len(places))
            out[at:at + len(places)] = self.flat[places]
            at += len(places)
        return out, ends

    def _forget(self, room: int) -> None:
        """Make room for that many words: of those that two batches had, the most frequent stay, half of the memory at most."""
        n = len(self.words)
        keep = np.flatnonzero((self.hits[:n] > 1) & (self.size[:n] <= KEPT_IDS))
        keep = keep[np.argsort(-self.hits[keep], kind="stable")[:max(0, min(MAX_WORDS // 2, MAX_WORDS - room))]]
        ids, _ = self._gather(keep)
        sizes, hits = self.size[keep], self.hits[keep]
        names = list(self.words)
        self._clear()
        self._append([names[i] for i in keep.tolist()], ids, sizes)
        self.hits[:len(keep)] = hits // 2

    def _ready(self, text: str) -> str:
        """The text with its pieces parted by spaces; the ids of these in turn are the text's.

        In texts that composition leaves alone, also in lower case, letters are lowered and an end mark
        between a letter or digit and white space is parted. Not so in pieces with one of the two letters
        whose lower case hangs on their neighbours or takes a mark, or with what may start a special token.
        """
        if unicodedata.is_normalized("NFC", text) and not any(x in text for x in ODD):
            lowered = text.lower() if self.folds else text
            if text.isascii() or unicodedata.is_normalized("NFC", lowered):
                if self.parts:
                    lowered = END_MARK.sub(r" \1", lowered)
                return lowered.replace("\n", " ")
        chunks = text.replace("\n", " ").split(" ")
        return " ".join(map(self._ready, chunks)) if len(chunks) > 1 else chunks[0]

    def _runs(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, and how many each has. Many go through the library as one text and are parted at the
        tokens that end a word; where these are not as many as the pre-tokens, each goes alone."""
        ids, sizes = [], []
        runs = [words[i:i + 200] for i in range(0, len(words), 200)]
        for at in range(0, len(runs), 100):
            part = runs[at:at + 100]
            for run, e in zip(part, tokenizer.encode_batch_fast([" ".join(r) for r in part], add_special_tokens=False)):
                own = np.array(e.ids, self.flat.dtype)
                ends = np.flatnonzero(self.last[own]) + 1
                if len(ends) == len(run):
                    ids.append(own)
                    sizes.append(np.diff(ends, prepend=0))
                else:
                    alone = [np.array(x.ids, self.flat.dtype) for x in tokenizer.encode_batch_fast(run, add_special_tokens=False)]
                    ids += alone
                    sizes.append(np.array([len(x) for x in alone]))
        return np.concatenate(ids), np.concatenate(sizes)

    def _encode_words(self, words: list[str]) -> None:
        """Number words that are not known. Words of plain characters are cut as the tokenizer cuts them, and other
        words of letters alone are one pre-token each; the library gets the rest as they are."""
        plain, pieces, counts, letters, rest = [], [], [], [], []
        for w in words:
            if self.bare and PLAIN.fullmatch(w) and "<|" not in w:
                found = [w] if w.isalpha() else PRE_TOKEN.findall(w)
                plain.append(w)
                pieces += found
                counts.append(len(found))
            elif self.last is not None and w.isalpha() and unicodedata.is_normalized("NFC", w):
                letters.append(w)
            else:
                rest.append(w)
        for tokenizer, some, parts, n in ((self.bare, plain, pieces, counts), (self.tokenizer, letters, letters, [1] * len(letters))):
            if some:
                ids, sizes = self._runs(tokenizer, parts)
                self._append(some, ids, np.add.reduceat(sizes, np.cumsum(n) - n))
        for at in range(0, len(rest), 10_000):
            part = rest[at:at + 10_000]
            own = [np.array(e.ids, self.flat.dtype) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._append(part, np.concatenate(own), np.array([len(x) for x in own]))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of words, -1 where one is not known."""
        get = self.words.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def _learn(self, wanted: list[str]) -> np.ndarray:
        """Numbers of these distinct words; those that are not known are encoded."""
        index = self._numbers(wanted)
        new = np.flatnonzero(index < 0)
        if len(self.words) + len(new) > MAX_WORDS or self.used > MAX_IDS:
            self._forget(len(wanted))
            index = self._numbers(wanted)
            new = np.flatnonzero(index < 0)
        missing = [wanted[i] for i in new.tolist()]
        self._encode_words(missing)
        index[new] = self._numbers(missing)
        self.hits[index] += 1
        return index

    def batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text; the unknown words of all are learnt together."""
        if not texts:
            return []
        parted = pc.split_pattern(pa.array(map(self._ready, texts), pa.large_string()), " ")
        rows = np.asarray(parted.offsets)
        words = parted.flatten().dictionary_encode()
        index = self._learn(words.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(words.indices)]
        ids, ends = self._gather(index)
        cuts = np.concatenate([[0], ends])[rows].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]


def _encoder(name: str, spec: str) -> ChunkEncoder:
    if name not in _TOKENIZERS:
        _TOKENIZERS[name] = ChunkEncoder(spec)
    return _TOKENIZERS[name]


def encode_records(docs: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """(shard, seq, value) of (doc, text) rows: their framed records in order, ``end_id`` appended to the ids.

    A shard is a partition of the rows. A blob holds about BLOB_BYTES of records or one longer one,
    without the line feed that ends its last record. Null texts are empty.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    name = hashlib.sha256(spec.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        from pyspark import TaskContext

        shard, seq = TaskContext.get().partitionId(), 0

        def blob() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([b"\n".join(held)], pa.binary())],
                names=["shard", "seq", "value"])

        encode = _encoder(name, shared.value)
        tail = b"" if end_id is None else np.array([end_id], encode.flat.dtype).tobytes()
        held: list[bytes] = []
        size = 0
        for b in slices(batches):
            ids = encode.batch([t or "" for t in b.column(1).to_pylist()])
            for key, own in zip(b.column(0).to_pylist(), ids):
                held.append(frame(key, own + tail, encode.width))
                size += len(held[-1]) + 1
                if size >= BLOB_BYTES:
                    yield blob()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield blob()

    return map_batches(docs.select("doc", "text"), run, "shard int, seq int, value binary")


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", shard_bytes: int = SHARD_BYTES,
) -> None:
    """Write ``path/data/shard=K/...`` in ascending key order, shard by shard, and ``path/index``.

    Shards are ranges of (key, hash of the text, row), about ``shard_bytes`` of text each where texts are
    alike, so that even a key with a third of all rows, or repeated rows, are spread over many. Texts are
    shuffled once, encoded in order and written by Spark's committer, so a lost executor leaves no half
    file. A file holds at most FILE_BLOBS blobs (16 MB in all, or longer records); the files of a shard go in
    the order of their numbers. Null keys come first; equal keys go in the order of their
    texts' hash; an empty table writes no records. The index has (shard, part, doc, offset, length, n_tokens,
    local_start, ids_crc32) for reads in any order, as read back from the files, every checksum verified.
    Further columns, whatever their names, are not looked at.
    """
    text_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-text_bytes // shard_bytes))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"),
        F.monotonically_increasing_id().alias("row"))
    order = (F.col("doc").asc_nulls_first(), F.col("tie"))
    placed = rows.repartitionByRange(n, *order, "row").sortWithinPartitions(*order)
    blobs = encode_records(placed, tokenizer_path, end_id).sortWithinPartitions("shard", "seq")
    blobs.select("shard", F.col("value").cast("string")).write.partitionBy("shard").option("maxRecordsPerFile", FILE_BLOBS).text(f"{path}/data")
    _scan(docs.sparkSession, f"{path}/data").write.parquet(f"{path}/index")


SCHEMA = ("shard int, part int, doc bigint, offset bigint, length bigint, n_tokens bigint, "
          "local_start bigint, ids_crc32 bigint")
#: Fixed by Spark's writer: shard and number of a file.
FILE_NAME = r"/shard=(\d+)/[^/]*[.-]c(\d+)[^/]*$"
#: Shards whose sizes are summed up in one group.
GROUP = 1024


def _scan(spark: SparkSession, data: str) -> DataFrame:
    """Every record of the files under ``data``, its checksums verified."""
    files = spark.read.format("binaryFile").load(data)
    at = lambda i: F.regexp_extract("path", FILE_NAME, i).cast("int")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                shard, part, content = (b.column(i)[k] for i in range(3))
                found = tuple([] for _ in range(6))
                doc, offset, length, size, start, crc = found
                total = 0
                for place, n, key, ids in read_frames(content.as_buffer()):
                    doc.append(key)
                    offset.append(place)
                    length.append(n)
                    size.append(len(ids))
                    start.append(total)
                    crc.append(zlib.crc32(ids.astype("<u4")))
                    total += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.as_py()] * len(doc), pa.int32()) for x in (shard, part)] + [pa.array(x, pa.int64()) for x in found],
                    names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(files.select(at(1).alias("shard"), at(2).alias("part"), "content"), run, SCHEMA)


def _starts(sizes: DataFrame) -> DataFrame:
    """(shard, part, before): ids of all files before, from (shard, part, n).

    Sums in two steps, groups of GROUP shards and then whole groups, so that the one task that orders the
    groups gets a row for each.
    """
    group = F.floor(F.col("shard") / GROUP).alias("g")
    inner = Window.partitionBy("g").orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    grouped = sizes.withColumn("g", group)
    totals = grouped.groupBy("g").agg(F.sum("n").alias("t")).select("g", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("base"))
    local = grouped.select("g", "shard", "part", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("own"))
    return local.join(totals, "g").select("shard", "part", (F.col("base") + F.col("own")).alias("before"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every record of the files, by the index that was read from them.

    ``start`` counts the ids of all documents before: the sum of the earlier files plus the place
    inside the file.
    """
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/index")
    starts = _starts(rows.groupBy("shard", "part").agg(F.sum("n_tokens").alias("n")))
    return rows.join(starts, ["shard", "part"]).select(
        "doc", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(content: bytes, offset: int, length: int) -> np.ndarray:
    """Ids of one record of a file by its place in the index."""
    return next(iter(read_frames(content[offset:offset + length])))[3]


def op9(docs: DataFrame) -> DataFrame:
    """Contract rows of op9; the files lie in the shared folder."""
    import public_tokenizers

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path).withColumnRenamed("doc", "doc_id")
