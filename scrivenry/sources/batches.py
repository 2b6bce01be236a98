"""Bounded Arrow batches for the operators that run Python on the executors."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scrivenry.sources.tables import worker_path

#: What an Arrow batch holds at most (one row at least).
RECORDS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Limit what passes between the JVM and a Python worker at once, by rows and by bytes.

    The limits belong to the session, so every operator sets the same ones, and only where the session
    sets none of its own; what an operator needs beyond that it does by ``slices``.
    """
    worker_path(spark)
    own = spark.conf.getAll
    for name, value in (("maxRecordsPerBatch", RECORDS), ("maxBytesPerBatch", BATCH_BYTES)):
        if f"spark.sql.execution.arrow.{name}" not in own:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def slices(batches: Iterable[pa.RecordBatch], records: int = RECORDS, megabytes: int = BATCH_BYTES >> 20) -> Iterator[pa.RecordBatch]:
    """The batches without empty ones, cut where they hold more rows or, by their mean row, more bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, min(records, (megabytes << 20) * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def release() -> None:
    """Give memory that a finished task no longer needs back to the machine; idle workers keep theirs otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` over bounded batches, by workers that hold no more than their task needs."""
    bound_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(task, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: StructType | str) -> DataFrame:
    """One output tuple for each input tuple. ``make`` runs once in each task and returns the function."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)
    types = [f.type for f in arrow]
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            rows = [work(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
            )

    return map_batches(df, run, schema)
