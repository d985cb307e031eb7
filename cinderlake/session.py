"""Table access and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that all executors see.

    Only where the setting is missing on a local master (tests) a temporary folder takes its place; on a cluster that
    is an error, because executors don't share such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors see")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession, older_than_hours: float = 24.0) -> int:
    """Delete what this library wrote below ``spark.checkpoint.dir`` over that long ago; the number of paths deleted.

    Paths are named ``label-hex``; others are left alone.
    """
    import re
    import time

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return 0
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs, gone = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    for status in fs.listStatus(path) if fs.exists(path) else ():
        old = time.time() - status.getModificationTime() / 1000 > older_than_hours * 3600
        if old and re.fullmatch(r"[a-z0-9-]+-[0-9a-f]{32}", status.getPath().getName()):
            gone += bool(fs.delete(status.getPath(), True))
    return gone


def written(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    The files survive the loss of any executor. ``partitions`` coalesces small results.
    """
    path = shared_folder(df.sparkSession, label)
    out = df.coalesce(partitions) if partitions else df
    out.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many tasks as leave about ``rows`` rows to each, and one per core at least: more rows, more tasks."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *keys)
