"""Order and outcome of copies between databases, and feeds polled in one plan."""

import pytest

from cinderlake.operators import guards
from cinderlake.sources import copying as K


def test_order():
    refs = [("c", "x", "b", "id"), ("b", "y", "a", "id"), ("d", "z", "d", "id"), ("e", "x", "gone", "id")]
    assert K.copy_order("edcba", refs) == ["a", "d", "e", "b", "c"]
    with pytest.raises(ValueError, match="round"):
        K.copy_order("ab", [("a", "x", "b", "id"), ("b", "x", "a", "id")])


def test_copy(spark, tmp_path):
    source = {
        "child": spark.createDataFrame([(1, 7, "p"), (2, None, "q"), (3, 9, "r")], "id int, parent int, old string"),
        "parent": spark.createDataFrame([(7, "a")], "id int, name string"),
        "empty": spark.createDataFrame([], "id int, parent int"),
        "only_here": spark.createDataFrame([(1,)], "id int"),
    }
    target = {"child": ["new", "parent", "id"], "parent": ["id", "name"], "empty": ["id"], "only_there": ["id"]}
    refs = [("child", "parent", "parent", "id"), ("empty", "parent", "parent", "id")]
    out = K.copy_database(spark, source, target, refs, {"child": "id", "empty": "id"}, lambda r, n: r.write.parquet(f"{tmp_path}/{n}"), lambda n: spark.read.parquet(f"{tmp_path}/{n}"))
    assert [tuple(r) for r in out.orderBy("step").collect()] == [("parent", 0, 1, None, 0), ("child", 1, 3, 4, 1), ("empty", 2, 0, 1, 0)]
    assert spark.read.parquet(f"{tmp_path}/child").columns == ["parent", "id"]


def test_polls(spark):
    feeds = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", True), ("e", None)], "feed string, enabled boolean")
    texts = spark.createDataFrame([("a", '[{"t": "1"}, {"t": null}]'), ("a", "oops"), ("b", '[{"t": "2"}]'), ("d", None), ("x", '[{"t": "3"}]'), ("a", "[]")], "feed string, value string")
    entries, status = guards.polled(feeds, texts, "struct<t:string>")
    assert sorted(map(tuple, entries.collect()), key=str) == [("a", "1"), ("a", None)]
    assert [tuple(r) for r in status.orderBy("feed").collect()] == [("a", "ok", 3, 1, 2), ("b", "off", 0, 0, 0), ("c", "missing", 0, 0, 0), ("d", "unreadable", 1, 1, 0), ("e", "off", 0, 0, 0)]
