import hashlib
from collections import Counter, defaultdict

import pytest
from fixtures import corpus, frame
from pyspark.sql import functions as F

from cinderlake.llm import exact_dedup
from cinderlake.llm.common import UPPER


def normal(t):
    return (t or "").translate(str.maketrans(UPPER, UPPER.lower()))


def brute(rows):
    groups = defaultdict(list)
    for doc, t in rows:
        groups[normal(t)].append(doc)
    out, seen = [], set()
    for doc, t in rows:
        own = groups[normal(t)]
        keep = max((d for d in own if d is not None), default=None)
        kept = doc == keep and (normal(t), doc) not in seen
        if doc == keep:
            seen.add((normal(t), doc))
        out.append((doc, keep, len(own), kept, hashlib.sha256(normal(t).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(500, "ÉCOLE Straße"), (501, "École Straße"), (502, "École straße"), (None, "alone"), (None, "alone")]
    assert Counter(map(tuple, exact_dedup.op5_exact_dedup(frame(spark, rows)).collect())) == brute(rows)


def test_small_buckets(spark):
    rows = corpus(3)
    got = exact_dedup.group_copies(frame(spark, rows), capacity=300).select("id", "keep_id", "group_size", "kept", "digest")
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_directory_splits(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"), F.lit(10).alias("bytes"))
    slots, depth = exact_dedup.directory(keys, 1250)
    held = keys.withColumn("slot", F.shiftrightunsigned("key", 64 - depth)).join(slots, "slot").groupBy("bucket").agg(F.sum("bytes").alias("n"))
    assert held.agg(F.sum("n"), F.max("n")).first()[0] == 10_000 and held.agg(F.max("n")).first()[0] <= 1250
    depths = {r[0] for r in slots.select("bucket.depth").distinct().collect()}
    assert max(depths) == depth and min(depths) < depth
    # a bucket is a whole range of slots
    assert all(r["first"] % (1 << depth - r["depth"]) == 0 for r in slots.select("bucket.*").collect())


def test_single_key_is_not_split(spark):
    keys = spark.createDataFrame([(5, 10_000), (-7, 1)], "key long, bytes long")
    slots, depth = exact_dedup.directory(keys, 100)
    assert depth <= 8 and slots.count() == 2


def test_owners_read_their_buckets(spark):
    rows = exact_dedup.group_copies(frame(spark, corpus(5)), capacity=300)
    assert rows.where("group_size > 1").count()
    texts = exact_dedup._texts(frame(spark, corpus(5)), "doc_id", "text")
    slots, depth = exact_dedup.directory(texts.select("key").distinct().withColumn("bytes", F.lit(100)), 300)
    index = exact_dedup.write_index(texts, slots, depth)
    grouped = index.groupBy("first", "depth", "key", "norm").count()
    grouped.collect()
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_keep_one(spark):
    rows = corpus(4)
    left = exact_dedup.keep_one(frame(spark, rows))
    texts = [normal(r["text"]) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({normal(t) for _, t in rows}) and "key" in left.columns


def test_very_long_and_tied(spark):
    long = "Sehr langer Text. " * 200_000
    rows = [(1, long), (2, long.upper()), (2, long), (3, long[:-1]), (None, None), (None, ""), (7, "x"), (7, "x"), (7, "X")]
    assert Counter(map(tuple, exact_dedup.op5_exact_dedup(frame(spark, rows)).collect())) == brute(rows)


def test_native(spark):
    plan = exact_dedup.op5_exact_dedup(frame(spark, corpus(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert exact_dedup.op5_exact_dedup(frame(spark, []).where("false")).count() == 0
