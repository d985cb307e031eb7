"""Copies of whole databases: parents before children, columns that both sides have, and what the copy broke."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cinderlake.sources.readers import copy_table

#: A reference: (table, column, table referred to, its column).
Reference = tuple[str, str, str, str]


def copy_order(tables: Iterable[str], references: Iterable[Reference]) -> list[str]:
    """Tables such that each comes after those it refers to, ties by name. A table may refer to itself; a longer cycle is an error."""
    tables = set(tables)
    graph: dict[str, set] = {t: set() for t in tables}
    for child, _, parent, _ in references:
        if child != parent and {child, parent} <= tables:
            graph[child].add(parent)
    sorter = TopologicalSorter(graph)
    try:
        sorter.prepare()
    except CycleError as e:
        raise ValueError(f"references go round: {' -> '.join(e.args[1])}") from e
    out: list[str] = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out


def copy_database(
    spark: SparkSession, source: dict[str, DataFrame], target: dict[str, list[str]], references: list[Reference], keys: dict[str, str],
    write: Callable[[DataFrame, str], None], read: Callable[[str], DataFrame],
) -> DataFrame:
    """``table, step, rows, next_id, orphans`` of a copy of the tables that both sides have.

    Each table is written once by ``write(rows, name)`` (a JDBC append in batches, or files), in ``copy_order``; rows and the
    largest key (``keys``, whole numbers) are observed while it is written, so ``next_id`` is what a sequence is set to, 1 for an empty table and null without a key.
    ``orphans`` counts rows of the copy (``read(name)``) whose non-null reference isn't there; references to tables or columns that weren't copied are passed over.
    """
    order, seen = copy_order(set(source) & set(target), references), {}
    columns = {t: [c for c in target[t] if c in source[t].columns] for t in order}
    for name in order:
        watch, key = Observation(), keys.get(name)
        last = F.max(F.col(key) if key in columns[name] else F.lit(None)).cast("long")
        write(copy_table(source[name], target[name]).observe(watch, F.count(F.lit(1)).alias("rows"), last.alias("last")), name)
        got = watch.get
        seen[name] = (got["rows"], None if key not in columns[name] else (got["last"] or 0) + 1)
    done = spark.createDataFrame([(t, k, *seen[t]) for k, t in enumerate(order)], "table string, step int, rows long, next_id long")
    lost = [
        read(child).where(F.col(c).isNotNull()).select(F.col(c).alias("_k")).join(read(parent).select(F.col(p).alias("_k")), "_k", "left_anti").agg(F.lit(child).alias("table"), F.count(F.lit(1)).alias("n"))
        for child, c, parent, p in references
        if c in columns.get(child, ()) and p in columns.get(parent, ())
    ]
    if not lost:
        return done.withColumn("orphans", F.lit(0).cast("long"))
    orphans = reduce(DataFrame.unionByName, lost).groupBy("table").agg(F.sum("n").alias("_orphans"))
    return done.join(F.broadcast(orphans), "table", "left").select("table", "step", "rows", "next_id", F.coalesce("_orphans", F.lit(0)).alias("orphans"))
