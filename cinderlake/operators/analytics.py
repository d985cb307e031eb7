"""Counts, series and rankings over an incident star. Time is always an argument (``as_of``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(when: Column, as_of: str, days: int) -> Column:
    """Within the last ``days`` days up to ``as_of``, from which a later instant is excluded."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return (when >= end - F.expr(f"INTERVAL {int(days)} DAYS")) & (when <= end)


#: Names of trailing windows in days; an unknown name means no filter.
PERIODS = {"7d": 7, "15d": 15, "1m": 30, "1y": 365}


def in_period(when: Column, as_of: str, period: str) -> Column:
    """Filter by a named trailing window."""
    return in_window(when, as_of, PERIODS[period]) if period in PERIODS else F.lit(True)


def top_k(counts: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k largest by ``by``, ties in ascending order of ``ties``; no global sort is needed."""
    return counts.orderBy(F.desc(by), *ties).limit(k)


def month_calendar(df_spark, as_of: str, months: int) -> DataFrame:
    """``month`` as yyyy-MM for the last ``months`` months up to that of ``as_of``."""
    return df_spark.sql(
        f"SELECT date_format(m, 'yyyy-MM') AS month FROM (SELECT explode(sequence(add_months(trunc(DATE'{as_of[:10]}', 'MM'), {1 - months}), trunc(DATE'{as_of[:10]}', 'MM'), INTERVAL 1 MONTH)) AS m)"
    )


def monthly_series(facts: DataFrame, when: str, as_of: str, months: int) -> DataFrame:
    """``month, n``: rows per month, zero where there are none, up to ``as_of``."""
    first = F.add_months(F.trunc(F.lit(as_of[:10]).cast("date"), "MM"), 1 - months)
    counts = facts.where((F.col(when) >= first.cast("timestamp_ntz")) & (F.col(when) <= F.lit(as_of).cast("timestamp_ntz"))).groupBy(F.date_format(when, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return month_calendar(facts.sparkSession, as_of, months).join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def daily_series(facts: DataFrame, when: str, as_of: str, days: int) -> DataFrame:
    """``day, n`` for the ``days`` days up to ``as_of``; the cutoff's own day isn't among them."""
    spark, end = facts.sparkSession, as_of[:10]
    calendar = spark.sql(f"SELECT explode(sequence(date_sub(DATE'{end}', {days - 1}), DATE'{end}')) AS day")
    counts = facts.groupBy(F.to_date(when).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def group_sparks(facts: DataFrame, key: str, when: str, as_of: str, months: int, keys: DataFrame | None = None) -> DataFrame:
    """``key, spark``: per key the monthly counts in order, zero-filled; one row per key.

    The calendar isn't multiplied with the keys: counts become a map per key, which is read by month.
    """
    first = F.add_months(F.trunc(F.lit(as_of[:10]).cast("date"), "MM"), 1 - months)
    start = F.lit(as_of[:10]).cast("date")
    rows = facts.where((F.col(when) >= first.cast("timestamp_ntz")) & (F.col(when) <= F.lit(as_of).cast("timestamp_ntz")))
    back = F.months_between(F.trunc(start, "MM"), F.trunc(F.col(when), "MM")).cast("int")
    counts = rows.groupBy(F.col(key), back.alias("back")).agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("back", "n"))).alias("by_month"))
    if keys is not None:
        held = keys.select(key).join(held, key, "left")
    slots = F.sequence(F.lit(months - 1), F.lit(0), F.lit(-1))
    empty = F.create_map().cast("map<int,bigint>")
    return held.select(key, F.transform(slots, lambda b: F.coalesce(F.try_element_at(F.coalesce("by_month", empty), b), F.lit(0))).alias("spark"))


def kpi_trend(facts: DataFrame, by: list[str], when: str, as_of: str, days: int) -> DataFrame:
    """Rows of the window, rows of the one before, and the change in per cent, rounded half to even; null without a base."""
    end = F.lit(as_of).cast("timestamp_ntz")
    middle, begin = end - F.expr(f"INTERVAL {days} DAYS"), end - F.expr(f"INTERVAL {2 * days} DAYS")
    at = F.col(when)
    now, before = F.count_if((at >= middle) & (at < end)), F.count_if((at >= begin) & (at < middle))
    out = facts.groupBy(*by).agg(now.alias("current"), before.alias("previous"))
    change = F.bround((F.col("current") - F.col("previous")) * 100.0 / F.nullif(F.col("previous"), F.lit(0)), 0)
    return out.withColumn("pct", change.cast("long"))


def coverage_matrix(facts: DataFrame, row: str, column: str, member: str, row_order: list[str]) -> DataFrame:
    """Distinct members per cell with the peak and the rank of a row: known rows first, others by name."""
    cells = facts.groupBy(row, column).agg(F.countDistinct(member).alias("n"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for i, r in enumerate(row_order) for x in (F.lit(r), F.lit(i))]), F.col(row)), F.lit(len(row_order)))
    peak = cells.agg(F.max("n").alias("peak"))
    within = F.row_number().over(Window.partitionBy(row).orderBy(F.desc("n"), column))
    return cells.withColumn("row_rank", rank).withColumn("place", within).crossJoin(F.broadcast(peak))


def like_escape(text: str) -> str:
    """A term for LIKE in which its own wildcards count as characters."""
    return "".join("\\" + c if c in "\\%_" else c for c in text)


def contains_ci(term: str, *columns: str) -> Column:
    """Case-insensitive containment in any column; no wildcards in the term."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))
    return found


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_counts(df: DataFrame, size: int) -> DataFrame:
    """``total, pages``; there is always one page."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def triage(alerts: DataFrame, when: str, seen: Column, strength: Column, as_of: str, recent_days: int) -> DataFrame:
    """Tier 0 unread, 1 recently read, 2 read before; ``place`` orders a tier by strength, then newest."""
    recent = F.col(when) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {recent_days} DAYS")
    tier = F.when(~seen, 0).when(recent, 1).otherwise(2)
    return alerts.withColumn("tier", tier).withColumn("strength", F.when(~seen, strength).otherwise(0))
