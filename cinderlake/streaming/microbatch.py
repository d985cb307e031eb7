"""Incremental jobs: micro-batches of a file source with state in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_increments(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files of a landing folder; its checkpoint is the high-water mark."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Work off what has arrived, batch by batch, and stop; a restart goes on after the last batch."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_matches(out: str, match: Callable[[DataFrame], DataFrame], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that writes new matches to ``out/batch=n``; writing a batch again replaces it."""

    def batch(rows: DataFrame, number: int) -> None:
        match(rows).dropDuplicates(keys).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return batch


def incremental_pairs(old_targets: DataFrame, new_targets: DataFrame, all_rows: DataFrame, new_rows: DataFrame, match: Callable[[DataFrame, DataFrame], DataFrame], known: DataFrame | None, keys: list[str]) -> DataFrame:
    """Old targets against new rows and new targets against all rows, without known pairs."""
    out = match(old_targets, new_rows).unionByName(match(new_targets, all_rows)).dropDuplicates(keys)
    return out if known is None else out.join(known.select(*keys), keys, "left_anti")


def missing_years(done: DataFrame, spark: SparkSession, source: str, first: int, last: int) -> DataFrame:
    """Years of a source without a marker ``source:year``, for a backfill that can be resumed."""
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    marks = done.where(F.col("key").startswith(f"{source}:")).select(F.split_part("key", F.lit(":"), F.lit(2)).cast("int").alias("year"))
    return years.join(marks, "year", "left_anti")


def windowed_counts(stream: DataFrame, when: str, size: str, late: str, by: list[str]) -> DataFrame:
    """Counts per tumbling window and key; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(when, late).groupBy(F.window(when, size), *by).agg(F.count(F.lit(1)).alias("n"))
