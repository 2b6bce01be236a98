"""Sinks: all-or-nothing tables, saved plans, diagnostics, processing state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from scrivenry.functions import text as X
from scrivenry.operators.notes import plan_reasons
from scrivenry.sources.batches import map_batches, slices
from scrivenry.sources.tables import materialise, note_made


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def _promote(spark: SparkSession, path: str) -> None:
    """Bring a published table, which a writer left beside its place, into its place."""
    fs, target, new = _fs(spark, path)
    published = new(f"{path.rstrip('/')}.next")
    if not fs.exists(published):
        return
    old = new(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"cannot set aside {path}")
    if not fs.rename(published, target):
        raise OSError(f"cannot put {path} in place")
    fs.delete(old, True)


def write_atomic(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write beside ``path``, publish by one rename and then move into place.

    From the rename to ``path.next`` on, the new table is the current one, before it the old one;
    ``read_current`` reads whichever that is, also after a crash at any point, which the next writer mends.
    """
    spark = df.sparkSession
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    df.write.format(kind).save(stage)
    _promote(spark, path)
    fs, _, new = _fs(spark, path)
    if not fs.rename(new(stage), new(f"{path.rstrip('/')}.next")):
        raise OSError(f"cannot publish {path}")
    _promote(spark, path)


def current(spark: SparkSession, path: str) -> str:
    """Where the current table of ``path`` lies."""
    fs, _, new = _fs(spark, path)
    published = f"{path.rstrip('/')}.next"
    return published if fs.exists(new(published)) else path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, new = _fs(spark, current(spark, path))
    return fs.exists(p)


def read_current(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """The last table that ``write_atomic`` published at ``path``."""
    return spark.read.format(kind).load(current(spark, path))


#: Files that one task reads back.
FILES_A_TASK = 2000


def _uri(path: str) -> str:
    """``file:/x``, as Hadoop prints it, in the form that Arrow reads."""
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _arrow_reads(path: str) -> bool:
    try:
        pafs.FileSystem.from_uri(_uri(path))
    except (pa.ArrowException, ValueError, OSError):
        return False
    return True


def write_files(texts: DataFrame, path: str, suffix: str = "") -> DataFrame:
    """(path) of the files below ``path``, one for each row of ``texts`` (value).

    The files are written by the tasks themselves and their paths are a table, so the driver neither moves nor lists
    them. Each attempt of a task has a folder of its own; only files of attempts that ended well are in the table.
    """
    at = _uri(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = pafs.FileSystem.from_uri(at)
        task, n = TaskContext.get(), 0
        folder = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        for b in slices(batches):
            if not n:
                store.create_dir(f"{root}/{folder}")
            paths = []
            for value in b.column(0):
                with store.open_output_stream(f"{root}/{folder}/{n:08d}{suffix}", compression=None) as f:
                    f.write((value.as_py() or "").encode())
                paths.append(f"{folder}/{n:08d}{suffix}")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    note_made(texts.sparkSession, "folder", path)
    return materialise(map_batches(texts.select("value"), run, "path string"), "files")


def read_files(paths: DataFrame, path: str) -> DataFrame:
    """(value) of the text files ``paths`` (path) below ``path``, each a whole row."""
    at = _uri(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(at)
        for b in slices(batches):
            held, size = [], 0
            for p in b.column(0).to_pylist():
                with store.open_input_file(f"{root}/{p}") as f:
                    held.append(f.readall().decode("utf-8", "replace"))
                size += len(held[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    parts = max(paths.sparkSession.sparkContext.defaultParallelism, -(-paths.count() // FILES_A_TASK))
    return map_batches(paths.repartition(parts), run, "value string")


def through_files(texts: DataFrame, path: str, suffix: str = "") -> DataFrame:
    """(value): ``texts`` (value) written as a file each and read back; by Spark's own files where Arrow does not know the store."""
    if _arrow_reads(path):
        return read_files(write_files(texts, path, suffix), path)
    note_made(texts.sparkSession, "folder", path)
    texts.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    raw = texts.sparkSession.read.text(path, wholetext=True)
    # a split holds few small files, so a task takes many splits
    return raw.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, -(-raw.rdd.getNumPartitions() // 100)))


PLAN = ("path", "action", "content", "base", "source_id", "source_hash", "version")
PLAN_SCHEMA = "path string, action string, content string, base string, source_id string, source_hash string, version int"


def _plan_rows(notes: DataFrame) -> DataFrame:
    """The columns of a plan; those that ``notes`` lacks are null."""
    kinds = dict(c.split() for c in PLAN_SCHEMA.split(", "))
    return notes.select(*[(F.col(c) if c in notes.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in PLAN])


def save_plan(notes: DataFrame, path: str, write: bool = False, exit_code: int = 0) -> str:
    """JSON lines of the planned notes with their digest, which is returned, and a copy for people in ``path.review``.

    Refused together with ``write``, after a failure (exit code other than 0), and where nothing is planned.
    """
    if write:
        raise ValueError("a plan is either saved or written")
    if exit_code:
        raise ValueError(f"the run failed with {exit_code}, so there is no plan to save")
    rows = _plan_rows(notes)
    if rows.isEmpty():
        raise ValueError("nothing was processed, so there is no plan to save")
    digest = plan_digest(rows)
    review = rows.select(F.concat(F.lit("# "), "action", F.lit(" "), "path", F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("value"))
    write_atomic(review, f"{path.rstrip('/')}.review", "text")
    write_atomic(rows.withColumn("digest", F.lit(digest)), path, "json")
    return digest


def plan_digest(rows: DataFrame) -> str:
    """Digest of a plan's rows in any order: their number and the sums of the parts of their digests."""
    each = _plan_rows(rows).select(X.sha256(F.to_json(F.struct(*PLAN))).alias("h"))
    part = lambda i: F.sum(F.conv(F.substr("h", F.lit(15 * i + 1), F.lit(15)), 16, 10).cast("decimal(38,0)"))
    sums = F.concat_ws("/", F.count(F.lit(1)).cast("string"), *[F.coalesce(part(i).cast("string"), F.lit("")) for i in range(4)])
    return each.agg(X.sha256(sums).alias("d")).first()["d"]


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{PLAN_SCHEMA}, digest string").json(current(spark, path))


def plan_checks(plan: DataFrame, digest: str, state: DataFrame, notes: DataFrame, spent: DataFrame) -> DataFrame:
    """What ``plan_reasons`` judges, one row for each planned note, from the state of things now.

    ``state`` has (source_id, content_hash) of the sources as they are, ``notes`` (path, content, origin) of the
    notes as they are, ``spent`` (digest) of plans that were applied.
    """
    found = plan_digest(plan)
    now = state.select(F.col("source_id").cast("string").alias("source_id"), F.col("content_hash").alias("found_hash"))
    held = notes.select("path", F.col("content").alias("found_base"), F.col("origin").alias("owner"))
    used = not spent.where(F.col("digest") == digest).isEmpty()
    return (
        plan.join(now, "source_id", "left").join(held, "path", "left")
        .select(F.col("path").alias("plan_id"), F.lit(digest).alias("digest"), F.lit(found).alias("found_digest"), F.col("version"), "source_hash",
                "found_hash", "path", "action", "base", "found_base", "owner", F.lit(used).alias("spent")))


def apply_plan(plan: DataFrame, checks: DataFrame, target: str, write: bool) -> bool:
    """Write exactly the planned notes if every precondition holds (``checks`` as plan_reasons takes it)."""
    if not plan_reasons(checks).where(~F.col("accepted")).isEmpty():
        return False
    if write:
        write_atomic(plan.select("path", "content"), target)
    return True


def write_diagnostics(failures: DataFrame, path: str) -> None:
    """Parse failures without source text: id, chunk, status, length and digest of the reply."""
    failures.select(
        *[c for c in failures.columns if c not in ("reply", "text", "content", "concept")],
        F.length("reply").alias("reply_chars"), X.sha256(F.col("reply")).alias("reply_sha256")).write.mode("append").json(path)


def next_state(state: DataFrame, processed: DataFrame) -> DataFrame:
    """Keyed state (source_id, content_hash): a processed source replaces its row."""
    return state.join(processed, "source_id", "left_anti").unionByName(processed.select(*state.columns))
