"""Shared column expressions of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``text, y`` of at most ``per_class`` labelled, not held-out documents of each class.

    Documents are taken in the order of a hash of doc_id, so the sample doesn't depend on the
    layout. A document with contradictory labels counts as 1. The sampled ids (two times
    ``per_class`` at most) are broadcast: no text is shuffled.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = ids.where("y = 1").orderBy(*order).limit(per_class).unionByName(ids.where("y = 0").orderBy(*order).limit(per_class))
    few = few.select(F.col("doc_id").alias("_id"), "y")
    return documents.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")


#: Rows of a small table that are broadcast, at most (about 100 MB as a hash table); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` marked for broadcast if it has ``rows`` rows at most. It should be a written table, since it is counted."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def free_name(documents: DataFrame, name: str) -> str:
    """``name``, with underscores appended while the table has a column of that name."""
    taken = {c.lower() for c in documents.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(documents: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``documents`` without the ids of ``gone`` (one column, distinct); texts aren't shuffled for few ids."""
    own = free_name(documents, "_gone")
    ids = gone.toDF(own)
    if not ids.where(F.col(own).isNull()).isEmpty():
        documents = documents.where(F.col(id_col).isNotNull())
    return documents.join(bounded(ids.where(F.col(own).isNotNull())), F.col(id_col) == F.col(own), "left_anti")
