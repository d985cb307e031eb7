"""Dedup, upsert and history of ingested rows. Order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.session import written


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by ``order``; null keys are equal to each other.

    An aggregate, not a window: rows of a key collapse on the map side, so a hot key does no harm.
    """
    rest = [c for c in rows.columns if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def duplicates(rows: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """``duplicate, original``: the rows that ``first_wins`` leaves out, and the row they repeat."""
    first = first_wins(rows.select(*dict.fromkeys([*keys, *order, id_col])), keys, order)
    kept = first.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(id_col).alias("original"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(kept, same).where(~F.col(id_col).eqNullSafe(F.col("original"))).select(F.col(id_col).alias("duplicate"), "original")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows of ``new`` to append: first per key, key not in ``old``."""
    return first_wins(new, keys, order).join(old.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full table after an upsert: values of ``new`` that aren't null win, other columns stay."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in rest])
    n = new.select(*keys, *[(F.col(c) if c in new.columns else F.lit(None)).alias(f"_n_{c}") for c in rest])
    return o.join(n, keys, "full").select(*keys, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in rest])


def get_or_create(dim: DataFrame, key: str, id_col: str, natural: DataFrame) -> DataFrame:
    """New rows of a dimension: natural keys it lacks, with ids that go on after its largest.

    The numbering counts per partition first, so no task meets all new keys.
    """
    new = natural.select(key).where(F.col(key).isNotNull()).distinct().join(dim.select(key), key, "left_anti")
    # written once: the partitions that rows are counted by are those that they are numbered in
    new = written(new.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "new-ranges")
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    new = new.withColumn("_n", nth)
    sizes = new.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select(F.col("_p"), (F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    last = dim.agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("_last"))
    out = new.join(F.broadcast(before), "_p").crossJoin(F.broadcast(last))
    return out.select((F.col("_last") + F.coalesce("_before", F.lit(0)) + F.col("_n")).alias(id_col), key)


def history(rows: DataFrame, key: str, payload: str, order: list[str]) -> DataFrame:
    """Rows whose payload differs from that before of their key: what a change history keeps."""
    before = F.lag(payload).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return rows.withColumn("_before", before).withColumn("_first", first).where("_first OR NOT _before <=> " + payload).drop("_before", "_first")


def evidence(current: DataFrame, new: DataFrame, keys: list[str], payload: str) -> tuple[DataFrame, DataFrame]:
    """Current table after new payloads, and the old rows that go to the history; equal payloads write nothing."""
    old = current.select(*keys, F.col(payload).alias("_old"))
    both = new.join(old, keys, "left")
    changed = both.where(F.col("_old").isNotNull() & (F.col("_old") != F.col(payload)))
    past = changed.select(*keys, F.col("_old").alias(payload))
    fresh = both.where(F.col("_old").isNull() | (F.col("_old") != F.col(payload))).drop("_old")
    return current.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh), past


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of parents that ``new`` has are replaced as a whole."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def purge(rows: DataFrame, when: str, as_of: str, days: int) -> DataFrame:
    """Rows that are younger than the retention."""
    return rows.where(F.col(when) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))


def cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children that stay after their parents were deleted."""
    return children.join(gone.select(key).distinct(), key, "left_anti")


def sample_per_group(rows: DataFrame, group: str, order: list, per_group: int) -> DataFrame:
    """At most ``per_group`` rows per group, first by ``order``; tasks prune their own rows first."""
    own = Window.partitionBy(group, "_salt").orderBy(*order)
    few = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(32))).withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= per_group)
    return few.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= per_group).drop("_salt", "_k")


def due(last_run: Column, as_of: str, every: str) -> Column:
    """Never run, or not within ``every``."""
    return last_run.isNull() | (last_run <= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {every}"))
