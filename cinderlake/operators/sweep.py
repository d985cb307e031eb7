"""Spans and points on one line, by a sweep over range partitions.

Begins of spans and points are sorted together, in ranges dealt by Spark, and written once. Along a range runs the furthest
end so far; what earlier ranges leave open is one row per range. So a span of any width, one over everything included, is a
single row, and no key gathers points. Equal points, and spans of equal begin, collapse before they are dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.session import written

#: Rows of a range, about.
RANGE_ROWS = 2_000_000


def _swept(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, at, kind, hi) with ``open``: the furthest end of the spans that begin at or before each, in its keys."""
    spark = rows.sparkSession
    n = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    order = [*keys, "at", "kind"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "sweep")
    end = F.when(F.col("hi").isNotNull(), F.struct(*keys, "hi"))
    # one row per range: what is open at its end, and before it
    last = dealt.groupBy("part").agg(F.max(end).alias("last"))
    before = last.withColumn("before", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "before")
    own = F.max(end).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("own", own).join(F.broadcast(before), "part")
    most = F.greatest("own", "before")
    same = F.lit(True)
    for k in keys:
        same = same & (most[k] == F.col(k))
    return out.withColumn("open", F.when(same, most["hi"])).drop("own", "before")


def covered_points(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """Distinct ``keys, at`` of the points that any span covers; both ends count. Null ends, keys and points cover nothing."""
    some = lambda df, c: df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in (*keys, c)))
    kind = spans.schema[hi].dataType
    p = some(points, at).select(*keys, F.col(at).alias("at")).distinct().select(*keys, "at", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("hi"))
    s = some(spans, lo).where(F.col(hi) >= F.col(lo)).groupBy(*keys, F.col(lo).alias("at")).agg(F.max(hi).alias("hi")).select(*keys, "at", F.lit(0).alias("kind"), "hi")
    out = _swept(p.unionByName(s), keys)
    return out.where("kind = 1 AND open >= at").select(*keys, F.col("at").alias(at))


def merged_spans(spans: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """``keys, lo, hi``: overlapping spans put together into disjoint ones.

    A span opens a new one if everything before it has ended. Within its range a merged span is
    counted by the openings so far; pieces of one span over several ranges meet by the number of openings in all ranges before.
    """
    kind = spans.schema[hi].dataType
    s = spans.where(F.col(hi) >= F.col(lo)).groupBy(*keys, F.col(lo).alias("at")).agg(F.max(hi).alias("hi")).select(*keys, "at", F.lit(0).alias("kind"), "hi")
    s = s.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    # a begin that is strictly after all that is open: the span itself doesn't count, so probes stand before begins
    probe = s.select(*keys, "at", F.lit(-1).alias("kind"), F.lit(None).cast(kind).alias("hi"))
    out = _swept(s.unionByName(probe), keys)
    opens = written(out.where("kind = -1 AND (open IS NULL OR open < at)").select(*keys, F.col("at").alias("first"), "part"), "sweep-opens")
    begin = F.max(F.when(F.col("opens"), F.struct(*keys, "at")))
    rows = out.where("kind = 0").join(opens.select(*keys, F.col("first").alias("at"), F.lit(True).alias("opens")), [*keys, "at"], "left").withColumn("opens", F.coalesce("opens", F.lit(False)))
    last = opens.groupBy("part").agg(F.max(F.struct(*keys, F.col("first").alias("at"))).alias("last"))
    ranges = out.select("part").distinct().join(last, "part", "left")
    before = ranges.withColumn("before", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "before")
    own = begin.over(Window.partitionBy("part").orderBy(*keys, "at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("own", own).join(F.broadcast(before), "part").withColumn("first", F.greatest("own", "before")["at"])
    return rows.groupBy(*keys, "first").agg(F.max("hi").alias("hi")).select(*keys, F.col("first").alias(lo), F.col("hi").alias(hi))
