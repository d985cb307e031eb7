import random
from collections import Counter

import numpy as np
import pytest
from fixtures import corpus, frame
from pyspark.sql import functions as F

from cinderlake.llm import decontaminate as D


def items_and_docs(seed):
    rnd = random.Random(seed)
    word = lambda: f"v{rnd.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(rnd.choice([3, 12, 25, 60])))) for k in range(12)]
    docs = []
    for k in range(60):
        item = items[rnd.randrange(12)][1].split()
        for _ in range(rnd.randrange(3)):
            item[rnd.randrange(len(item))] = word()
        own = [word() for _ in range(rnd.randrange(80))]
        at = rnd.randrange(len(own) + 1)
        docs.append((1000 + k, " ".join(own[:at] + (item if k % 2 else item[: len(item) // 3]) + own[at:]).title()))
    return items, docs


def brute(items, text):
    runs, best = D.shingles(D.words_of(text)), {}
    for item, t in items:
        own = D.shingles(D.words_of(t))
        for s in range(max(1, len(runs) - len(own) + 1)) if runs and own else ():
            sim = D.similarity(Counter(runs[s : s + len(own)]), Counter(own))
            if sim >= 0.8 and sim > best.get(item, 0):
                best[item] = sim
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_brute_force(spark, seed):
    items, docs = items_and_docs(seed)
    docs += corpus(seed)
    bench = spark.createDataFrame([*items, (77, None), (78, " ")], "item_id long, text string")
    out, name = D.contamination(frame(spark, docs).withColumn("leaks", F.lit("mine")), bench)
    got = out.select("doc_id", F.col(name).alias("leaks"), F.col("leaks").alias("own")).collect()
    assert len(got) == len(docs) and {r["own"] for r in got} == {"mine"}
    want = Counter((d, tuple(sorted(brute(items, t)))) for d, t in docs)
    assert Counter((r["doc_id"], tuple(sorted(x["item_id"] for x in r["leaks"]))) for r in got) == want
    assert sum(1 for _, x in want if x) > 4


def test_parts_of_items(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEM_WORDS", 30)
    items, docs = items_and_docs(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench = bench.unionByName(bench.where("item_id = 3"))  # an item of two parts counts once
    assert len(list(D.item_parts(bench))) > D.PARTS_AT_ONCE
    got = D.op10_decontaminate(frame(spark, docs), bench).collect()
    assert {r["doc_id"]: r["n_items"] for r in got} == {d: len(brute(items, t)) for d, t in docs}


@pytest.mark.parametrize("words", [200_000, 30])
def test_names_as_ids(spark, monkeypatch, words):
    """Ids of any type; the best item, its similarity and all items are those of brute force, in one part and in many."""
    monkeypatch.setattr(D, "ITEM_WORDS", words)
    items, docs = items_and_docs(5)
    docs += docs[:3] + [(500, docs[0][1] + " " + docs[1][1]), (501, None), (501, docs[2][1])]
    named = [(f"mmlu-{k}", t) for k, t in items]
    bench = spark.createDataFrame([*named, (None, items[0][1])], "item_id string, text string")
    given = spark.createDataFrame([(d, t, "d", "l") for d, t in docs], "doc_id long, text string, _digest string, _leaks string").repartition(3)
    want = []
    for d, t in docs:
        found = {f"mmlu-{k}": v for k, v in brute(items, t).items()}
        best = min(((-v, k) for k, v in found.items()), default=(None, None))
        want.append((d, bool(found), len(found), best[1], None if best[0] is None else round(-best[0], 9), ",".join(sorted(found))))
    got = [(r["doc_id"], r["contaminated"], r["n_items"], r["best_item"], None if r["similarity"] is None else round(r["similarity"], 9), r["items"]) for r in D.op10_decontaminate(given, bench).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(r[1] for r in got) > 4
    assert D.contamination(given, bench)[0].select("_digest", "_leaks").distinct().collect() == [("d", "l")]


def test_empty(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.op10_decontaminate(frame(spark, []).where("false"), bench).count() == 0
    none = D.op10_decontaminate(frame(spark, [(1, "a b")]), bench.where("false")).collect()
    assert not none[0]["contaminated"]


def test_moved_parts():
    """Passages whose parts are in another order are found as by brute force, with the same similarity."""
    rnd = random.Random(7)
    word = lambda: f"m{rnd.randrange(5000)}"
    items = [(k, [word() for _ in range(100)]) for k in range(6)]
    index = D.Items([(k, " ".join(w)) for k, w in items])
    for k, w in items:
        cut = 50 if k < 3 else 20 + 10 * k
        text = " ".join([word() for _ in range(300)] + w[cut:] + w[:cut] + [word() for _ in range(300)])
        want = brute([(k, " ".join(w)) for k, w in items], text)
        assert set(want) == {k} and index.matches(text) == want


def test_tables_find_all_within_the_radius():
    """The block tables return every fingerprint within RADIUS, as comparing with each does."""
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 300, np.uint64)
    near = prints.copy()
    for k in range(300):
        for bit in rng.choice(64, k % 26, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    want = {(a, b) for a in range(300) for b in range(300) if (int(near[a]) ^ int(prints[b])).bit_count() <= D.RADIUS}
    assert set(D.Tables(prints).within(near)) == want and len(want) > 200


def test_recall_of_the_radius():
    """Of edited passages at a similarity from 0.8 to 0.85, which fingerprints tell least, 0.99 are found."""
    rnd = random.Random(9)
    word = lambda: f"m{rnd.randrange(10**6)}"
    items = [(k, [word() for _ in range(rnd.randrange(30, 120))]) for k in range(150)]
    index, found, all_of = D.Items([(k, " ".join(w)) for k, w in items]), 0, 0
    for k, w in items:
        for _ in range(6):
            own = list(w)
            for at in rnd.sample(range(len(own)), max(1, len(own) // 48)):
                own[at] = word()
            text = " ".join([word() for _ in range(9)] + own + [word() for _ in range(9)])
            best = brute([(k, " ".join(w))], text).get(k, 0)
            if 0.8 <= best < 0.85:
                all_of += 1
                found += k in index.matches(text)
    assert all_of > 150 and found >= 0.99 * all_of


def test_without_leaks_keeps_columns(spark):
    items, docs = items_and_docs(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    given = frame(spark, docs + [(9, None), (9, ""), (10, "w " * 100_000)]).withColumn("leaks", F.lit(5)).withColumn("similarity", F.lit("s"))
    left = D.without_leaks(given, bench)
    assert left.columns == given.columns and {(r["leaks"], r["similarity"], r["score"]) for r in left.collect()} == {(5, "s", 2.0)}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted([9, 9, 10] + [d for d, t in docs if not brute(items, t)])
