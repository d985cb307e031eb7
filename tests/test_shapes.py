"""Merged structures as rows against a plain version, and whatever order they come in."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinderlake.operators import contracts as C
from cinderlake.operators import shapes as H


def plain(values):
    """The stated form, by recursion over all values of a node at once."""
    kinds = {k for v in values for (p, k) in H.nodes(v) if p == ()} - {C.EMPTY, C.NULL}
    if len(kinds) > 1:
        return C.VARIES
    if not kinds:
        return C.NULL if any(v is None for v in values) else C.EMPTY
    if kinds == {"list"}:
        return [plain([x for v in values if isinstance(v, list) for x in v])]
    if kinds == {"dict"}:
        objects = [v for v in values if isinstance(v, dict) and v]
        keys = {k for v in objects for k in v}
        every = [x for v in objects for x in v.values()]
        if any(set(v) != keys for v in objects) and plain(every) != C.VARIES:
            return {"*": plain(every)}
        return {k: plain([v[k] for v in objects if k in v]) for k in keys}
    return kinds.pop()


json_values = st.recursive(st.none() | st.booleans() | st.integers(0, 3) | st.sampled_from(["", "a"]), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.sampled_from("abc"), v, max_size=3), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(json_values, json_values)
def test_two_structures_merge_as_one_after_another(a, b):
    flat = lambda v: json.dumps(v, sort_keys=True).replace('"null"', '"empty"')
    one_list = lambda v: not any(p.count("[]") for p, _ in H.nodes(v))
    if one_list(a) and one_list(b):
        assert flat(plain([a, b])) == flat(C.merge(C.structure(a), C.structure(b)))


def test_rows_against_the_plain_version(spark):
    rng = random.Random(5)

    def value(depth):
        r = rng.random()
        if depth > 3 or r < 0.35:
            return rng.choice([None, True, 1, 2.5, "", "x", [], {}])
        if r < 0.5:
            return [value(depth + 1) for _ in range(rng.randint(1, 3))]
        return {k: value(depth + 1) for k in rng.sample(["a", "b.c", "d", "*"], rng.randint(1, 3))}

    groups = {g: [value(0 if g % 2 else 2) for _ in range(rng.randint(1, 6))] for g in range(40)}
    groups[None] = [{"a": {"x": 1}}, {"b": {"y": 2}}, {"c": {"x": None}}]
    rows = [(g, json.dumps(v), "clash") for g, vs in groups.items() for v in vs] + [(0, None, ""), (1, "no json", "")]
    random.Random(1).shuffle(rows)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g int, body string, path string").repartition(parts)
        got = {r["g"]: json.loads(r["structure"]) for r in H.shape_texts(H.shape_rows(df, ["g"], "body"), ["g"]).collect()}
        assert got == {g: plain(vs) for g, vs in groups.items()}
    assert got[None] == {"*": {"*": "number"}}


def test_a_hundred_thousand_free_keys_are_one_map(spark):
    df = spark.range(100_000).selectExpr("1 AS g", """concat('{"k', id, '": {"v": ', id, ', "w', id % 3, '": 1}}') AS body""")
    got = {("".join(r["path"]), r["kind"], r["n"]) for r in H.shape_rows(df, ["g"], "body").collect()}
    assert got == {("", "dict", 100_000), (".*", "dict", 100_000), (".*.*", "number", 200_000)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "{")]])
def test_nothing_to_read(spark, rows):
    assert H.shape_rows(spark.createDataFrame(rows, "g int, body string"), ["g"], "body").count() == 0


def test_deep_values_end(spark):
    deep = "[" * 30 + "1" + "]" * 30
    got = H.shape_texts(H.shape_rows(spark.createDataFrame([(1, deep)], "g int, body string"), ["g"], "body"), ["g"]).first()
    assert json.loads(got["structure"]) == C.structure(json.loads(deep))


def test_payloads_are_dealt_to_tasks(spark, monkeypatch):
    """Payloads of one file's part are taken apart in tasks of bounded size; the nodes stay the same."""
    df = spark.range(400).selectExpr("id % 2 AS g", "concat('{\"k', id, '\": ', id, '}') AS body").coalesce(1)
    want = sorted(map(str, H.shape_rows(df, ["g"], "body").collect()))
    dealt = []
    monkeypatch.setattr(H, "TASK_PAYLOADS", 20)
    monkeypatch.setattr(H, "node_column", lambda c, was=H.node_column: dealt.append(c) or was(c))
    monkeypatch.setattr(H, "written", lambda rows, label, was=H.written: dealt.append(rows._jdf.queryExecution().optimizedPlan().toString()) or was(rows, label))
    assert sorted(map(str, H.shape_rows(df, ["g"], "body").collect())) == want
    assert "Repartition 20, true" in dealt[1]
