"""The pipeline against plain versions of its stages, on the smallest tables."""

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from cinderlake.llm import decontaminate as D
from cinderlake.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        left = {r["doc_id"] for r in out.collect()}
        if name == "toxicity":
            machine = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert left == {d for d, s in zip(rows, machine.scores(rows.values())) if s < 0.5}
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for d, t in rows.items():
                groups["".join(c.lower() if c < "\x7f" else c for c in t)].append(d)
            assert left == {max(g) for g in groups.values()}
        elif name == "decontamination":
            items = D.Items([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
            assert left == {d for d, t in rows.items() if not items.matches(t)}
        else:
            shingles = {d: frozenset(D.shingles(D.words_of(t))) for d, t in rows.items()}
            label = {d: d for d in rows}
            for a in rows:
                for b in rows:
                    if a < b and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]) and label[a] != label[b]:
                        lo, hi = sorted((label[a], label[b]))
                        label = {d: lo if x == hi else x for d, x in label.items()}
            assert left == {d for d in rows if label[d] == d}
        docs, rows = out, {d: t for d, t in rows.items() if d in left}
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(rows)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_awkward_rows(spark):
    """Nulls, repeated rows and clashing columns pass every stage; empty tables stay empty."""
    from fixtures import corpus, frame

    docs = frame(spark, corpus(2) + [(None, "idiot " * 3), (800, "x " * 5000), (801, "long " * 300_000)])
    for name in ("leaks", "toxicity", "predicted", "_gone", "norm", "fp"):
        docs = docs.withColumn(name, F.lit(77))
    for none in (False, True):
        left = docs.where("false") if none else docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.written(stage(spark, left, SF), name)
            assert out.columns == docs.columns and out.count() <= left.count()
            assert none or {tuple(r) for r in out.drop("doc_id", "text").distinct().collect()} == {tuple(r) for r in docs.drop("doc_id", "text").distinct().collect()}
            left = out
        assert left.isEmpty() == none
        assert corpus_pipeline.pack(spark, left, SF).isEmpty() == none
