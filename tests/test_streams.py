"""Stateful streams against batch queries, over restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cinderlake.session import shared_folder
from cinderlake.streaming import attempts as A
from cinderlake.streaming import outbox as O


def rows(seed=2, n=400):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    idle = [("idle", start + dt.timedelta(seconds=k), True, 1000 + k) for k in range(7)]  # locked early, then silent
    return idle + [(f"u{rnd.randrange(6)}", start + dt.timedelta(seconds=40 * k + rnd.randrange(30)), rnd.random() < 0.85, k) for k in range(n)]


def test_locks_in_batch(spark):
    data = [*rows(), (None, dt.datetime(2024, 1, 1), True, 1)]
    want, state = [], {}
    for key, at, failed, k in sorted(data, key=lambda r: (str(r[0]), r[1], r[3])):
        fails = state.get(key, 0) + 1 if failed else 0
        state[key] = fails
        want.append((key, k, fails, at + dt.timedelta(seconds=A.lock_seconds(fails)) if fails >= 5 else None))
    df = spark.createDataFrame(data, "key string, at timestamp, failed boolean, ord long")
    got = A.locks_in_batch(df).select("key", "ord", "fails", "until").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and max(w[2] for w in want) > 9
    assert [A.lock_seconds(n) for n in (0, 4, 5, 6, 9, 10, 11, 400)] == [0, 0, 30, 60, 480, 900, 900, 900]


def test_stream_is_the_batch_after_a_restart(spark):
    """Three runs over files that arrive, from one checkpoint; the last rows are those of the batch query."""
    data, landed, out, checkpoint = rows(), shared_folder(spark, "attempts"), shared_folder(spark, "locks"), shared_folder(spark, "locks-checkpoint")
    df = spark.createDataFrame(data, "key string, at timestamp, failed boolean, ord long")
    for part in (data[:150], data[150:300], data[300:]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(landed)
        stream = A.locks(spark.readStream.schema(df.schema).parquet(landed), "10 minutes")
        with A.state_store(spark):
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(out)
    attempts = got.where("what = 'attempt'").select("key", "at", "ord", "fails", "until")
    assert sorted(map(str, attempts.collect())) == sorted(map(str, A.locks_in_batch(df).collect()))
    # a lock that ends before the next attempt of its key, and before the watermark, is reported open, once
    opened = got.where("what = 'open'").groupBy("key", "at").count().collect()
    untils = {(r["key"], r["until"]) for r in attempts.where("until IS NOT NULL").collect()}
    assert all((r["key"], r["at"]) in untils and r["count"] == 1 for r in opened) and [r["at"] for r in opened if r["key"] == "idle"] == [dt.datetime(2024, 1, 1, 0, 2, 6)]


def test_state_is_asked_for_once():
    """A key costs one look at its state, and further calls only where state or timer change; attempts count in their order, those without a number last."""
    calls = []

    class Held:
        value = None

        def __getattr__(self, name):
            def call(*args):
                calls.append((name, *args))
                if name in ("update", "clear"):
                    Held.value = args[0] if args else None
                return {"get": Held.value, "getValueState": self}.get(name)

            return call

    def run(*attempts):
        calls.clear()
        got = list(locks.handleInputRows(("u",), iter([Row(us=us, ord=o, failed=f) for us, o, f in attempts]), None))
        return [(r.us, r.ord, r.fails, r.until, r.what) for r in got], [c[0] for c in calls]

    locks = A._processor()
    locks.init(Held())
    assert run((9, 1, False)) == ([(9, 1, 0, None, "attempt")], ["get"])
    failed, asked = run((50, None, True), (50, 7, True), (20, 2, True), (30, 3, True), (40, 4, True))
    assert failed == [(20, 2, 1, None, "attempt"), (30, 3, 2, None, "attempt"), (40, 4, 3, None, "attempt"), (50, 7, 4, None, "attempt"), (50, None, 5, 30_000_050, "attempt")]
    assert asked == ["get", "update", "registerTimer"] and Held.value == (5, 30_000_050)
    assert [tuple(r) for r in locks.handleExpiredTimer(("u",), None, None)] == [("u", 30_000_050, None, 5, None, "open")]
    assert run((60, 8, False)) == ([(60, 8, 0, None, "attempt")], ["get", "clear", "deleteTimer"])
    assert list(locks.handleExpiredTimer(("u",), None, None)) == []


def _send(spark, landed, path, checkpoint, schema, broken=None):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(landed)
    if broken is not None:
        stream = stream.withColumn("name", F.when(F.col("id") == broken, F.raise_error(F.lit("killed"))).otherwise(F.col("name")))
    O.send(stream.repartition(4, "id"), path, checkpoint, size=7).awaitTermination()


def test_outbox_is_written_once(spark):
    """Tasks of a batch that dies leave files, but no event: after the restart every event is there once."""
    schema, landed, path, checkpoint = "id long, name string, at timestamp", shared_folder(spark, "landed"), shared_folder(spark, "outbox"), shared_folder(spark, "outbox-checkpoint")
    events = lambda a, b: spark.range(a, b).select("id", F.concat(F.lit("é "), F.col("id").cast("string")).alias("name"), F.timestamp_seconds("id").alias("at")).coalesce(1)
    events(0, 100).write.mode("append").json(landed)
    _send(spark, landed, path, checkpoint, schema)
    events(100, 200).write.mode("append").json(landed)
    with pytest.raises(Exception, match="killed"):
        _send(spark, landed, path, checkpoint, schema, broken=199)
    assert sorted(r["id"] for r in O.events(spark, path, schema).collect()) == list(range(100))
    _send(spark, landed, path, checkpoint, schema)
    got = O.events(spark, path, schema).collect()
    assert sorted(r["id"] for r in got) == list(range(200)) and {r["name"] for r in got if r["id"] == 7} == {"é 7"} and [r["at"].timestamp() for r in got if r["id"] == 9] == [9]
    bodies = O.batches(spark, path).collect()
    assert all(1 <= r["n"] <= 7 for r in bodies) and sum(r["n"] for r in bodies) == 200


def test_a_batch_is_committed_once(tmp_path):
    """A second commit of a batch, as after a crash between sink and checkpoint, adds nothing and clears its files."""
    writer = O.Writer({"path": str(tmp_path), "size": "2"}, ["id"])
    one, two = writer.write(iter([{"id": k} for k in range(5)])), writer.write(iter([{"id": k} for k in range(5)]))
    writer.commit([one, None], 0)
    writer.commit([two], 0)
    writer.commit([writer.write(iter([]))], 1)
    assert [len(names) for names in O.manifests(str(tmp_path))] == [1, 0]
    assert len(list((tmp_path / "data").iterdir())) == 1
    writer.abort([writer.write(iter([{"id": 9}])), None], 2)
    assert len(list((tmp_path / "data").iterdir())) == 1
