import random
from itertools import permutations

import duckdb
import pytest
from fixtures import corpus

from cinderlake.llm import filter_audit
from cinderlake.llm.tries import Trie, common_length


def test_trie():
    rnd = random.Random(3)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(9))) for _ in range(400)] + [b"a" * 5000, b"a" * 4999 + b"b", b"", "é".encode()]
    trie, want = Trie(min), {}
    for k, t in enumerate(texts):
        n = -k if k % 3 else k
        trie.insert(t, n)
        want[t] = min(want.get(t, n), n)
    assert dict(trie.walk()) == want and [t for t, _ in trie.walk()] == sorted(want)
    assert sorted(trie.values()) == sorted(want.values()) and trie.terminals == len(want)
    assert trie.bytes < sum(map(len, want))
    for a, b in ((b"", b"x"), (b"abc", b"abd"), (b"abc", b"abc"), (b"ab", b"abc"), (b"x", b"y"), (b"aaaab", b"aaaac")):
        n = common_length(a, b)
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


WORDS = "Die Der the ON x y z".split()


def rows() -> list[tuple]:
    """doc_id, text, lang: awkward texts, long ones, copies in and across parts."""
    rnd = random.Random(7)
    out = [(i, t, ("en", "de", None, "")[k % 4]) for k, (i, t) in enumerate(corpus())]
    out += [(200 + k, " ".join(rnd.choice(WORDS) + str(rnd.randrange(400)) for _ in range(rnd.choice([150, 199, 200, 260]))) + rnd.choice(["", "$", " A|B"]), rnd.choice(["en", "fr"])) for k in range(30)]
    out += [(300 + k, out[rnd.randrange(len(out))][1], rnd.choice(["en", "de", None])) for k in range(40)]
    return [*out, (300, out[60][1], "en"), (None, out[61][1], "en"), (None, None, None), (2000, "w " * 200_000 + "end", "xx"), (1999, "w " * 200_000 + "end", "xx"), (1, "É" * 100 + "ABC", "en")]


LABELS = [(k, k % 2, k % 3 == 0) for k in range(0, 340)] + [(5, 1, False), (300, 0, True), (None, 1, True), (4, None, None)]


def frames(spark, some=None):
    some = rows() if some is None else some
    docs = spark.createDataFrame([(i, t, p, "s", 1, 2, "k") for i, t, p in some], "doc_id long, text string, lang string, part string, n int, mask int, label string").repartition(5)
    labels = spark.createDataFrame([(i, q, None if t is None else int(t), "x") for i, q, t in LABELS], "doc_id long, quality int, toxic int, text string")
    return docs, labels


def plain(some) -> list[str]:
    good, toxic = {i for i, q, _ in LABELS if q == 1 and i is not None}, {i for i, _, t in LABELS if t and i is not None}
    least: dict = {}
    for i, t, _ in some:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, p in some:
        t = t or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]
        fails = "".join(c for c, f in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t]), strict=True) if f)
        docs.append((p or "", fails, i in good, i in toxic))
    out, shapley = [], {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                fail = [d for d in docs if d[0] == part and f in d[1]]
                out.append([part, "".join(order), step, len(left), len(gone), len(fail) - len(gone), sum(d[1] == f for d in fail), sum(d[2] for d in gone), sum(d[3] for d in gone)])
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return sorted(str((*r, shapley[r[0], r[1][r[2] - 1]])) for r in out)


@pytest.mark.parametrize("capacity", [32_000_000, 400])
def test_orders(spark, capacity, monkeypatch):
    monkeypatch.setattr(filter_audit, "OWN_BYTES", 16_000_000 if capacity > 400 else 500)
    docs, labels = frames(spark)
    got = filter_audit.orders(filter_audit.masks(docs, labels, capacity)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows())


def test_sql(spark):
    docs, labels = frames(spark)
    con = duckdb.connect()
    for name, df in (("documents", docs.select("doc_id", "text", "lang")), ("labels", labels.select("doc_id", "quality", "toxic"))):
        con.register(name, df.toArrow())
    want = con.sql(filter_audit.ORACLE)
    got = filter_audit.op12_filter_audit(docs, labels).select(*want.columns).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want.fetchall()))


def test_cuts(spark):
    """The different texts of a range fit; a common beginning is cut where texts part."""
    texts = ["same " * 100 + str(k) for k in range(60)] + ["hot"] * 500 + [str(k) * 3 for k in range(300)] + [""] * 9
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    cuts = filter_audit.prefix_cuts(df, 1200)
    held: dict = {}
    for t in texts:
        held.setdefault(sum(c <= t for c in cuts), []).append(t)
    assert cuts == sorted(set(cuts)) and all(len(set(v)) == 1 or sum(map(len, set(v))) <= 3 * 1200 for v in held.values())
    assert len(cuts) < 3 * sum(map(len, texts)) / 1200


def test_copies_collapse(spark):
    """A text that most rows have reaches its range once per task."""
    docs, labels = frames(spark, [(k, "copy", "en") for k in range(1000)] + [(2000, "other", "en")])
    got = filter_audit.masks(docs, labels).groupBy("mask").sum("n").collect()
    assert {r[0]: r[1] for r in got} == {1: 2, 17: 999}


def test_empty(spark):
    docs, labels = frames(spark)
    assert filter_audit.op12_filter_audit(docs.where("false"), labels).count() == 0
    assert filter_audit.op12_filter_audit(docs, labels.where("false")).where("good_lost + toxic_lost > 0").count() == 0
