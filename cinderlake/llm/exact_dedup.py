"""Exact deduplication with an extendible-hash index on shared files. DataFrame functions only.

The pseudo-key of a text is the 64-bit hash of its normalised form. A row whose pseudo-key no other
row has is alone. The texts of all others go to an index in the shared folder:

1. The directory has a slot per leading bits of the pseudo-key. It starts with one bucket; a bucket that
   holds more than ``capacity`` bytes splits, which doubles the directory where needed, until every bucket
   fits or has a single pseudo-key. Buckets are ranges of pseudo-keys.
2. Texts are written to the files of their bucket. Before that, copies collapse in the writing tasks and
   once more per lane of ``LANES``, so that a bucket gets at most that many rows of a text however often it occurs.
3. The owner task of a bucket reads its file and no other, chains equal pseudo-keys and compares the
   bytes: only equal bytes, not equal hashes, make a group.

Each row finds its group by pseudo-key and SHA-256, so no text is sent back.

Defined results: a null text counts as empty, so null and empty texts are one group. Rows that
repeat a doc_id and text are one group and only one of them is kept. A null doc_id is smaller
than any other; it is kept only in a group without other ids. Of equal largest ids any one row stays. An empty
table gives no rows. A text of any length is one value; a bucket with a single text over ``capacity`` isn't split.
Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import ascii_lower, bounded, without
from cinderlake.session import shared_folder, written

#: Rows of one text that a bucket gets at most.
LANES = 64


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return documents.select(F.col(id_col).alias("id"), norm.alias("norm")).select("id", "norm", F.xxhash64("norm").alias("key"))


def _slot(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a pseudo-key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(held: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """``slot, bucket`` for every slot in use, and the depth of the directory.

    ``held`` has one row per pseudo-key: ``key, bytes``. A bucket is named by the smallest slot that it has, and by
    its own depth. The depth grows until every bucket fits or has a single pseudo-key.
    """
    total = held.agg(F.sum("bytes")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1.0, total / capacity))))
    while True:
        slots = held.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("keys"))
        slots = written(slots, "exact-slots")
        if depth == 64 or slots.where((F.col("bytes") > capacity) & (F.col("keys") > 1)).isEmpty():
            break
        depth = min(64, depth + 1)
    levels = slots.select("slot", "bytes", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    levels = levels.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {depth} - d)"))
    fits = levels.groupBy("d", "prefix").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= capacity).drop("bytes")
    leaf = levels.join(fits, ["d", "prefix"]).groupBy("slot").agg(F.min("d").alias("d"))
    own = slots.select("slot").join(leaf, "slot", "left").withColumn("d", F.coalesce("d", F.lit(depth)))
    first = F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - d), {depth} - d)")
    return own.select("slot", F.struct(first.alias("first"), F.col("d").alias("depth")).alias("bucket")), depth


def write_index(texts: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """The index: ``bucket, key, norm, keep_id, rows`` in files of their buckets, read in place."""
    spark = texts.sparkSession
    lane = F.pmod(F.spark_partition_id(), F.lit(LANES))
    met = texts.groupBy(lane.alias("lane"), "key", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("rows"))
    dealt = met.withColumn("slot", _slot(F.col("key"), depth)).join(bounded(slots), "slot").select("bucket.first", "bucket.depth", "key", "norm", "keep_id", "rows")
    files, name, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"exact_{uuid.uuid4().hex}", shared_folder(spark, "exact-index")
    owner = ["first", "depth"]
    dealt.repartition(files, *owner).write.option("compression", "zstd").option("path", path).bucketBy(files, *owner).saveAsTable(name)
    index = spark.table(name)
    index.schema  # resolves the table while its name exists; the files stay
    spark.sql(f"DROP TABLE {name}")
    return index


def group_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 16_000_000) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, digest``."""
    texts = _texts(documents, id_col, text_col)
    size = F.octet_length("norm").cast("long")
    rows = texts.select("key", "id", F.sha2("norm", 256).alias("digest"), size.alias("bytes"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "exact-rows")
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("most")).where("n > 1")
    held = written(held.select("key", (F.col("most") * F.least("n", F.lit(LANES)) + 64).alias("bytes")), "exact-held")
    slots, depth = directory(held, capacity)
    index = write_index(texts.join(bounded(held.select("key")), "key", "left_semi"), written(slots, "exact-directory"), depth)
    groups = index.groupBy("first", "depth", "key", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    groups = groups.where("group_size > 1").select("key", F.sha2("norm", 256).alias("digest"), "keep_id", "group_size")
    found = written(rows.drop("bytes").join(bounded(written(groups, "exact-groups")), ["key", "digest"], "left"), "exact-found")

    alone = F.col("group_size").isNull()
    largest = alone | F.col("id").eqNullSafe(F.col("keep_id"))
    ties = found.where(~alone & largest).groupBy("key", "digest").agg(F.max("row").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ties = written(ties, "exact-ties")
    if ties.isEmpty():
        kept = largest
    else:
        found = found.join(bounded(ties), ["key", "digest"], "left")
        kept = largest & F.coalesce(F.col("row") == F.col("last"), F.lit(True))
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return found.select("id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "digest")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that stay, all columns: one per distinct normalised text."""
    out = written(group_copies(documents, id_col, text_col).where("group_size > 1").select("id", "kept"), "exact-copies")
    stay = out.where("kept").select("id")
    gone = written(out.where("not kept").select(F.col("id").alias("_gone")).distinct(), "exact-gone")
    lasting = without(documents, gone, id_col)
    twice = written(stay.join(gone, F.col("id").eqNullSafe(F.col("_gone"))).select("_gone"), "exact-repeated")
    if twice.isEmpty():
        return lasting
    repeated = documents.join(twice, F.col(id_col).eqNullSafe(F.col("_gone")), "left_semi").dropDuplicates([id_col])
    return lasting.unionByName(repeated)


def op5_exact_dedup(documents: DataFrame) -> DataFrame:
    """The contract's columns from :func:`group_copies`."""
    out = group_copies(documents)
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
