"""Updates of tables as rewrites: marks, flags, clipped rows, enriched arrays with an audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mark(rows: DataFrame, flag: str, where: Column) -> DataFrame:
    """Sets a flag on rows that meet a condition."""
    return rows.withColumn(flag, F.col(flag) | F.coalesce(where, F.lit(False)))


def act(alerts: DataFrame, where: Column, as_of: str) -> DataFrame:
    """Toggles ``actioned_at`` of some alerts; whoever acts on an alert has seen it."""
    when = F.when(F.coalesce(where, F.lit(False)), F.when(F.col("actioned_at").isNull(), F.lit(as_of).cast("timestamp_ntz"))).otherwise(F.col("actioned_at"))
    return alerts.withColumn("actioned_at", when).withColumn("seen", F.col("seen") | F.col("actioned_at").isNotNull())


def enabled(control: DataFrame, names: DataFrame, key: str, number: str) -> DataFrame:
    """``key, enabled``: 1 or a missing row means enabled."""
    return names.select(key).join(control.select(key, number), key, "left").select(key, (F.coalesce(number, F.lit(1)) == 1).alias("enabled"))


def clipped(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Text columns cut to what their table holds."""
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in widths.items()})


def append_values(current: DataFrame, new: DataFrame, key: str, column: str, sources: str, least: int = 1, refused: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Arrays that only grow: values of ``new`` (key, value, sources) with enough sources and not refused are
    appended in order, and each change leaves an audit row (key, before, after)."""
    good = new.where((F.col(sources) >= least) & ~F.lower("value").isin(*[r.lower() for r in refused])).groupBy(key).agg(F.array_sort(F.collect_set("value")).alias("_new"))
    both = current.join(good, key, "left").withColumn("_old", F.coalesce(column, F.array().cast("array<string>")))
    both = both.withColumn("_after", F.concat("_old", F.array_except(F.coalesce("_new", F.array().cast("array<string>")), F.col("_old"))))
    audit = both.where(F.size("_after") > F.size("_old")).select(key, F.col("_old").alias("before"), F.col("_after").alias("after"))
    return both.withColumn(column, F.col("_after")).drop("_new", "_old", "_after"), audit


def reverted(current: DataFrame, audit: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Arrays as before the first change of the audit rows."""
    first = audit.groupBy(key).agg(F.min_by("before", order).alias("_b"))
    return current.join(first, key, "left").withColumn(column, F.coalesce("_b", column)).drop("_b")


def reachable(floors: DataFrame, kind: str, highest: str, floor: str) -> DataFrame:
    """Kinds whose best possible score doesn't reach their floor."""
    return floors.where(F.col(highest) < F.col(floor)).select(kind)


def backoff(failures: Column, free: int = 5, base: int = 30, most: int = 900) -> Column:
    """Seconds to wait after so many failures: none while free, then doubling up to a cap."""
    return F.when(failures < free, 0).otherwise(F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), F.least(failures - free, F.lit(20))))).cast("int")


def feed_tally(attempts: DataFrame, source: str, ok: Column, later: Column, size: Column) -> DataFrame:
    """Per source: stored, refused, deferred and mean size of what was stored."""
    return attempts.groupBy(source).agg(
        F.count_if(ok).alias("ok"), F.count_if(~ok & ~later).alias("refused"), F.count_if(~ok & later).alias("deferred"), F.avg(F.when(ok, size)).alias("mean_chars")
    )
