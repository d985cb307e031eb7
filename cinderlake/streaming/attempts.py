"""Attempts that arrive one by one: failures count, a success forgets them, and too many lock a key for a while.

The state of a key is its failures since the last success and the time until which it is locked. :func:`locks` keeps it in a stream,
:func:`locks_in_batch` states the same by windows over a whole table.

Defined results: a failure under ``FREE`` locks nothing; the n-th from there on locks for ``BASE * 2 ** (n - FREE)`` seconds, ``MOST`` at most, from its own
time. Attempts of one time count in the order of ``order``. A null key is a key like any other; an attempt that is neither failure nor success, or has no
time, changes nothing and isn't reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: Failures that lock nothing, seconds of the first lock, and of the longest.
FREE, BASE, MOST = 5, 30, 900
STATE = "fails int, until long"
OUT = Row("key", "us", "ord", "fails", "until", "what")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def lock_seconds(fails: int) -> int:
    return 0 if fails < FREE else min(MOST, BASE * 2 ** min(fails - FREE, 20))


def prepared(rows: DataFrame, key: Column, at: Column, failed: Column, succeeded: Column, order: Column) -> DataFrame:
    """``key, at, failed, ord`` of the attempts that count."""
    some = rows.select(key.cast("string").alias("key"), at.cast("timestamp").alias("at"), F.when(failed, True).when(succeeded, False).alias("failed"), order.cast("long").alias("ord"))
    return some.where("failed IS NOT NULL AND at IS NOT NULL")


def locks_in_batch(attempts: DataFrame) -> DataFrame:
    """``key, at, ord, fails, until`` after each attempt of ``key, at, failed, ord``."""
    by = Window.partitionBy("key").orderBy("at", "ord")
    run = F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    fails = F.count_if("failed").over(Window.partitionBy("key", "run").orderBy("at", "ord").rowsBetween(Window.unboundedPreceding, 0))
    out = attempts.withColumn("run", run).withColumn("fails", fails.cast("int"))
    seconds = F.least(F.lit(MOST), F.lit(BASE) * F.pow(F.lit(2), F.least(F.col("fails") - FREE, F.lit(20)))).cast("int")
    until = F.when(F.col("failed") & (F.col("fails") >= FREE), F.col("at") + F.make_dt_interval(secs=seconds))
    return out.select("key", "at", "ord", "fails", until.alias("until"))


def _processor():
    from pyspark.sql.streaming import StatefulProcessor

    class Locks(StatefulProcessor):
        """One value per key, and a timer for the end of its lock. Times are microseconds, whatever the session's time zone.

        A key has few attempts in a batch: they are rows, since frames of a few rows cost more than the work. The state is asked for once.
        """

        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("lock", STATE)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
            fails, until = before = self.state.get() or (0, None)
            out = []
            for at, ord_, failed in sorted(((r.us, r.ord, r.failed) for r in rows), key=_in_time):
                fails, until = (fails + 1, None) if failed else (0, None)
                if seconds := lock_seconds(fails):
                    until = at + seconds * 1_000_000
                out.append(OUT(key[0], at, ord_, fails, until, "attempt"))
            if fails and (fails, until) != before:
                self.state.update((fails, until))
            elif not fails and before[0]:
                self.state.clear()
            if before[1] != until:
                if before[1] is not None:
                    self.handle.deleteTimer(before[1] // 1000)
                if until is not None:
                    self.handle.registerTimer(until // 1000)
            return iter(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
            fails, until = self.state.get() or (0, None)
            return iter([OUT(key[0], until, None, fails, None, "open")] if until is not None else [])

        def close(self) -> None:
            pass

    return Locks()


def _in_time(attempt: tuple) -> tuple:
    at, ord_, _ = attempt
    return at, ord_ is None, ord_ or 0


def locks(attempts: DataFrame, late: str = "1 hour") -> DataFrame:
    """The stream ``key, at, ord, fails, until, what`` for a stream ``key, at, failed, ord``.

    A row ``attempt`` follows each attempt, and a row ``open`` the end of a lock, once the watermark (``late`` behind the newest attempt) has passed it. Start the query within
    :func:`state_store`. Rows of a batch are taken by time, batches as they arrive.
    """
    schema = "key string, us long, ord long, fails int, until long, what string"
    keyed = attempts.withColumn("us", F.unix_micros("at")).withWatermark("at", late).groupBy("key")
    out = keyed.transformWithState(statefulProcessor=_processor(), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select("key", F.timestamp_micros("us").alias("at"), "ord", "fails", F.timestamp_micros("until").alias("until"), "what")
