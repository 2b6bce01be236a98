"""Parquet table access and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, through Spark's own reader (any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def worker_path(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package; a cluster gets it through ``--py-files``."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset a temporary folder is made, and only where driver and executors are one machine
    (master ``local``); elsewhere that folder would not be shared, so the setting is asked for.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not conf and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="scrivenry-"))
    return (conf or sc.getCheckpointDir()).rstrip("/")


#: Folders and tables of intermediate results, by application.
_MADE: dict[str, list[tuple[str, str]]] = {}


def note_made(spark: SparkSession, kind: str, name: str) -> None:
    """Remember a ``folder`` or ``table`` for ``release``."""
    _MADE.setdefault(spark.sparkContext.applicationId, []).append((kind, name))


def release(spark: SparkSession) -> int:
    """Delete the intermediate results of this application; what reads them must be written before."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for kind, name in made:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            continue
        p = jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(made)


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The lineage is cut at a table that survives lost executors, and an expensive
    or non-repeatable stage below it runs exactly once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    note_made(spark, "folder", path)
    return spark.read.schema(df.schema).parquet(path)
