"""Quality, language and toxicity: held-out accuracy on the given tables, and awkward rows."""

import numpy as np
import pytest
from fixtures import corpus, frame
from pyspark.sql import functions as F

from cinderlake.llm import language, quality, toxicity

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]


def auc(y, s):
    rank = np.argsort(np.argsort(s, kind="stable")) + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("op", "label", "least"), [(toxicity.op9_toxicity, "toxic", 0.97), (quality.op4_quality, "quality", 0.97)])
def test_held_out(spark, op, label, least):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    got = op(docs, labels).join(labels.groupBy("doc_id").agg(F.max(label).alias("y")), "doc_id").where("held_out").toPandas()
    assert auc(got["y"].to_numpy(), got["score"].to_numpy()) > least
    assert (got["y"] == got["predicted"]).mean() > 0.93 and got["score"].between(0, 1).all()


def test_language_held_out(tables):
    docs, _ = tables
    got = language.op8_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_awkward_rows(spark, tables):
    docs, labels = tables
    rows = frame(spark, corpus(1) + [(700, "12 34 !!"), (701, "é" * 5)])
    out, name = language.identify(rows.withColumn("language", F.lit(7)), docs)
    lang = out.select("doc_id", f"{name}.lang_pred", "language", "score").collect()
    assert {(r["language"], r["score"]) for r in lang} == {(7, 2.0)}
    assert {r["lang_pred"] for r in lang if r["doc_id"] in (0, 1, 2, 700)} == {"und"} and len(lang) == rows.count()
    for op in (toxicity.toxicity, quality.quality):
        out, name = op(rows.withColumn("toxicity", F.lit(5)).withColumn("quality", F.lit(6)), labels)
        assert out.where(f"{name}.score between 0 and 1 and {name}.predicted in (0, 1)").count() == rows.count()
        assert {(r["score"], r["toxicity"], r["quality"]) for r in out.select("score", "toxicity", "quality").collect()} == {(2.0, 5, 6)}


def test_without_labels(spark, tables):
    docs, labels = tables
    none = labels.where("false")
    assert {r["score"] for r in toxicity.op9_toxicity(docs, none).select("score").distinct().collect()} == {0.0}
    assert {r["score"] for r in quality.op4_quality(docs, none).select("score").distinct().collect()} == {0.5}
    assert {r["lang_pred"] for r in language.op8_language(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()} == {"und"}


def test_empty(tables):
    docs, labels = tables
    assert toxicity.op9_toxicity(docs.where("false"), labels).count() == 0
    assert quality.op4_quality(docs.where("false"), labels).count() == 0
    assert language.op8_language(docs.where("false")).count() == 0


def test_interactions():
    """The machine learns that two terms count only together."""
    rng = np.random.default_rng(0)
    x = (rng.random((600, 6)) < 0.5).astype(np.float32)
    y = (x[:, 0] * x[:, 1]).astype(np.float32)
    bias, table = toxicity.train(x, y, epochs=400, l2=0)
    machine = toxicity.Machine({}, bias, table)
    total = x @ machine.table
    logit = bias + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(1) - x @ (machine.table[:, 1:] ** 2).sum(1))
    assert ((logit > 0) == (y > 0)).mean() > 0.97


def test_automaton():
    moves = language.suffix_automaton(b"abracadabra")
    for k in range(11):
        state = 0
        for c in b"abracadabra"[k:]:
            state = moves[state][c]
    assert ord("d") not in moves[moves[0][ord("b")]]


def plain_phrases(data: bytes, sample: bytes) -> int:
    """Longest matches one after another, found by searching the sample."""
    n = at = 0
    while at < len(data):
        size = 1
        while at + size < len(data) and data[at : at + size + 1] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


@pytest.mark.parametrize("stretch", [512, 16, 3])
def test_phrases_as_plain_parsing(spark, tables, monkeypatch, stretch):
    """Phrases are the longest matches, across stretches too, also where texts are copies of the sample."""
    monkeypatch.setattr(language, "STRETCH", stretch)
    docs, _ = tables
    texts = [r["text"] for r in docs.where("length(text) < 3000").limit(25).collect()]
    normal = lambda t: language.normal_bytes(t).tobytes()
    kept = [b" ".join(normal(t) for t in texts[k : k + 3])[:4000] for k in (0, 7)] + [b"ab" * 300]
    learned = language.Languages([language.Automaton.build(str(k), x) for k, x in enumerate(kept)])
    texts += ["", "ab" * 700, "q", "xyz!" * 50, texts[0] + texts[1] + texts[2], "ab" * 40 + texts[7] + "ab" * 290, texts[0][50:] * 3]
    got = learned.phrases(texts)
    assert got.tolist() == [[plain_phrases(normal(t), x) for x in kept] for t in texts]


def test_repeated_stretches_are_looked_up(monkeypatch):
    """Long runs that never meet the stretches' own phrases, with few stretches remembered, against what is known of them."""
    monkeypatch.setattr(language, "KEPT", 3)
    sample = b"xyz " + b"a" * 240 + b" xyz"
    learned = language.Languages([language.Automaton.build("a", sample)])
    texts = ["a" * n for n in (239, 240, 241, 100_000, 2_000_003)] + ["b" * 600 + "a" * 5000 + "xyz" + "a" * 3000]
    got = learned.phrases(texts)[:, 0].tolist()
    assert got[:-1] == [-(-len(t) // 240) for t in texts[:-1]]
    assert got[-1] == plain_phrases(texts[-1].encode(), sample)


def test_all_languages_are_learned(spark):
    """However many labels there are; a language with copies of one text and one long text is learned from both."""
    rows = [(100 * k + j, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in ("ona", "tir", "lek", "mus")), f"l{k:02}", "s") for k in range(70) for j in range(4)]
    rows += [(9000 + k, "zzz yyy " * 5000 if k in (3, 4, 5) else "kopie text " * 30, "zz", "s") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    learned = language.learn(docs)
    assert len(learned.automata) == 71
    names, _ = learned.predict([r[1] for r in rows])
    assert names == [r[2] for r in rows]


def test_sample_doesnt_depend_on_layout(spark, tables):
    docs, _ = tables
    a, b = (language.samples(d, 24_000, 100).orderBy("lang", "slot").collect() for d in (docs, docs.repartition(7)))
    assert a == b and len(a) > 100


def test_votes_as_brute_force(tables):
    """Scores are the similarity-weighted share of label 1 among the nearest vectors, found one by one."""
    docs, labels = tables
    space = quality.fit(docs, labels)
    texts = [r["text"] for r in docs.limit(40).collect()] + [None, "", "x"]
    got, vectors = space.scores(texts, block=7), space.project(texts)
    for vector, score in zip(vectors, got, strict=True):
        near = sorted((-float(vector @ v), k) for k, v in enumerate(space.vectors))[: quality.NEIGHBOURS]
        weight = [max(-s, quality.LEAST) ** 8 for s, _ in near]
        assert abs(score - sum(w * space.labels[k] for w, (_, k) in zip(weight, near)) / sum(weight)) < 1e-3


def test_machine_as_pair_sums(spark, tables):
    """Scores are the logistic of bias, weights and the products of all pairs' factors."""
    docs, labels = tables
    machine = toxicity.fit(docs, labels)
    texts = [r["text"] for r in docs.limit(30).collect()] + [None, "", "123"]
    for text, score in zip(texts, machine.scores(texts), strict=True):
        rows = [machine.table[machine.place[s]] for s in toxicity.slots(text) if s in machine.place]
        logit = machine.bias + sum(float(r[0]) for r in rows)
        logit += sum(float(rows[a][1:] @ rows[b][1:]) for a in range(len(rows)) for b in range(a))
        assert abs(score - 1 / (1 + np.exp(-np.clip(logit, -30, 30)))) < 1e-4


def test_contradictory_labels(spark):
    """A document labelled both ways counts as 1, one labelled twice counts once."""
    from cinderlake.llm.common import labelled_sample

    docs = spark.createDataFrame([(k, f"t{k}") for k in range(1, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)] * 2 + [(4, 1), (6, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["y"] for r in labelled_sample(docs, labels, "toxic", 100).collect()}
    assert got.get(4, 1) == 1 and all(y == (d % 2 or d == 4) for d, y in got.items()) and len(got) > 15


def _decided_by_a_pair(n: int, seed: int = 3) -> tuple[list, list]:
    """Label 1 if a text has one of two words but not both; neither word differs between the classes."""
    import random

    rnd, docs, labels = random.Random(seed), [], []
    for k in range(n):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        words = [f"filler{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(12))}" for _ in range(30)] + ["insult"] * a + ["group"] * b
        rnd.shuffle(words)
        docs.append((k, " ".join(words)))
        labels.append((k, int(a != b)))
    return docs, labels


def test_a_pair_of_words_decides(spark):
    docs, labels = _decided_by_a_pair(3000)
    got = toxicity.op9_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    truth = dict(labels)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) > 0.95 * len(got) > 400


def test_nothing_stands_out(spark):
    """Labels without any relation to the words: every score is the share of label 1."""
    docs, _ = _decided_by_a_pair(400)
    labels = [(k, int(k % 4 == 0)) for k, _ in docs]
    got = {round(r["score"], 9) for r in toxicity.op9_toxicity(spark.createDataFrame([(k, "same words here") for k, _ in docs], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == 1 and 0.15 < got.pop() < 0.35
