"""Plans that replaced others for scale: same rows as brute force, and what makes them scale."""

import ipaddress
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake.functions import fuzzy
from cinderlake.operators import addresses as A
from cinderlake.operators import dense, near, sweep, terms
from cinderlake.operators import matching as M
from cinderlake.operators import text as X


@pytest.mark.parametrize("rows_of_a_range", [7, 2_000_000])
def test_sweep(spark, rows_of_a_range, monkeypatch):
    monkeypatch.setattr(sweep, "RANGE_ROWS", rows_of_a_range)
    rnd = random.Random(4)
    spans = [(k, lo, lo + rnd.choice([0, 1, 3, 40])) for k in "ab" for lo in (rnd.randrange(900) for _ in range(60))] + [("a", 5, 2), ("a", None, 3), (None, 1, 9), ("c", 0, 10_000), ("c", 10_000, None), ("d", 3, 3)]
    points = [(rnd.choice("abcde"), rnd.randrange(950)) for _ in range(400)] + [("a", None), (None, 4), ("c", 10_000), ("d", 3), ("d", 3)]
    s, p = spark.createDataFrame(spans, "k string, lo long, hi long"), spark.createDataFrame(points, "k string, at long")
    whole = [x for x in spans if None not in x and x[1] <= x[2]]
    want = {x for x in points if None not in x and any(k == x[0] and lo <= x[1] <= hi for k, lo, hi in whole)}
    got = [tuple(r) for r in sweep.covered_points(p, s, ["k"], "at", "lo", "hi").collect()]
    assert sorted(got) == sorted(want)
    merged = []
    for k, lo, hi in sorted(whole):
        if merged and merged[-1][0] == k and lo <= merged[-1][2]:
            merged[-1][2] = max(hi, merged[-1][2])
        else:
            merged.append([k, lo, hi])
    assert sorted(tuple(r) for r in sweep.merged_spans(s, ["k"], "lo", "hi").collect()) == sorted(map(tuple, merged))


def test_one_span_over_everything(spark, monkeypatch):
    """A /0 span is one row; no range of the sweep has more than its share of the points."""
    monkeypatch.setattr(sweep, "RANGE_ROWS", 500)
    spans = spark.range(20_000).select((F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 4).alias("hi"), F.lit(1).alias("v"))
    points = spark.range(30_000).select((F.col("id") * 7).alias("at"), F.lit(1).alias("v")).union(spark.range(30_000).select(F.lit(9).cast("long"), F.lit(1)))
    assert sweep.covered_points(points, spans, ["v"], "at", "lo", "hi").count() == sum(x % 10 <= 4 and x < 200_000 for x in range(0, 210_000, 7))
    wide = spans.union(spark.createDataFrame([(0, 10**9, 1)], "lo long, hi long, v int"))
    assert sweep.covered_points(points, wide, ["v"], "at", "lo", "hi").count() == 30_000 + 1
    dealt = sweep._swept(points.distinct().select("v", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("hi")), ["v"])
    sizes = [r[0] for r in dealt.groupBy("part").count().select("count").collect()]
    assert len(sizes) > 40 and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_addresses(spark):
    entries = ["10.0.0.1", " 10.0.0.0/8 ", "10.0.0.9/31", "1.2.3.4/32", "0.0.0.0/0", "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4/33", "1.2.3.4/08", "10.0.0.0/255.0.0.0", "10.0.0.5-10.0.0.9", "9.9.9.9 - 1.1.1.1", "::1", "fe80::/10", "::ffff:1.2.3.4", "1.1.1.1-::1", "", None, "x"]
    df = spark.createDataFrame([(e,) for e in entries], "e string")
    got = {r["e"]: r["s"] and tuple(r["s"]) for r in df.select("e", A.span(F.col("e")).alias("s")).collect()}
    for e in entries:
        assert got[e] == A._span(e) or got[e] is None and A._span(e) == (None, None, None), e
    rnd = random.Random(8)
    ranges = [f"{rnd.randrange(1, 30)}.{rnd.randrange(256)}.0.0/{rnd.choice([9, 12, 16, 22, 30])}" for _ in range(40)] + ["2001:db8::/32", "bad"]
    points = [f"{rnd.randrange(1, 30)}.{rnd.randrange(256)}.{rnd.randrange(4)}.1" for _ in range(300)] + ["2001:db8::1", "2001:db9::1", "nothing", None] + ["5.5.5.5"] * 50
    nets = [ipaddress.ip_network(r, strict=False) for r in ranges[:-1]]
    inside = lambda p: p not in (None, "nothing") and any(ipaddress.ip_address(p) in n for n in nets)
    spans = spark.createDataFrame([(r,) for r in ranges], "r string").select(A.span(F.col("r")).alias("s")).select("s.*")
    out = A.covered(spark.createDataFrame([(p,) for p in points], "a string"), "a", spans).collect()
    assert sorted((str(r["a"]), r["covered"]) for r in out) == sorted((str(p), inside(p)) for p in points)
    both = A.merged(spans).collect()
    assert len(both) == len(list(ipaddress.collapse_addresses(n for n in nets if n.version == 4))) + 1 or len(both) <= len(nets)


TEXTS = [(1, "She sells sea shells"), (2, "he"), (3, None), (4, ""), (5, "ÀÉ usher İ"), (2, "HERS"), (None, "she"), (6, "x" * 200_000 + "hers")]


@pytest.mark.parametrize("most_bytes", [4_000_000, 30])
def test_terms(spark, most_bytes):
    words = [(1, "he"), (2, "SHE"), (3, "hers"), (4, "she"), (5, ""), (6, None), (7, "àé"), (8, "sells sea"), (9, "zzz"), (2, "he"), (10, "İ")]
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    known = spark.createDataFrame(words, "term_id int, term string")
    got = terms.terms_found(rows, "doc_id", F.col("text"), known, "term_id", "term", most_bytes)
    k = known.where("term IS NOT NULL").select("term_id", F.lower("term").alias("t")).distinct()
    want = rows.withColumn("row", F.monotonically_increasing_id()).join(k, F.contains(F.lower("text"), F.col("t"))).select("row", "term_id", "t", "doc_id")
    assert sorted(map(str, got.select("term_id", "doc_id").collect())) == sorted(map(str, want.select("term_id", "doc_id").collect()))
    assert terms.terms_found(rows, "doc_id", F.col("text"), known.where("false"), "term_id", "term").count() == 0


def test_few_terms_are_the_same(spark, monkeypatch):
    """Both ways of looking for terms agree, letters without case and empty terms included."""
    known = spark.createDataFrame([(1, "he"), (2, "SHE"), (3, ""), (4, None), (5, "àé"), (1, "he"), (1, "hers"), (6, "İ")], "watch_id int, term string")
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    found = lambda: sorted(str(tuple(r)) for r in M.watch_contains(rows, "doc_id", F.col("text"), known).distinct().collect())
    one = found()
    monkeypatch.setattr(M, "FEW_TERMS", 0)
    assert one == found() and len(one) > 8


def test_fifty_thousand_terms(spark):
    """One pass over the texts, whatever the number of terms."""
    words = [(k, f"w{k * 7919 % 1_000_003}q") for k in range(50_000)]
    rows = spark.createDataFrame([(d, " ".join(words[(d * 31 + j * 17) % 50_000][1] + "," for j in range(200))) for d in range(40)], "doc_id long, text string")
    got = terms.terms_found(rows, "doc_id", F.col("text"), spark.createDataFrame(words, "term_id int, term string"), "term_id", "term")
    assert {(r["term_id"], r["doc_id"]) for r in got.collect()} == {((d * 31 + j * 17) % 50_000, d) for d in range(40) for j in range(200)}


def test_chains(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (103, 100), (5, 900), (None, 3), (70, None)]
    df = spark.createDataFrame(edges, "s long, d long")
    to: dict = {}
    for s, t in edges:
        if s is not None and t is not None:
            to[s] = min(t, to.get(s, t))
    for hops in (1, 2, 3, 10, 13, 64):
        want = {}
        for s in to:
            at, n = s, 0
            while n < hops and at in to:
                at, n = to[at], n + 1
            want[s] = (at, n)
        assert {r["s"]: (r["target"], r["n"]) for r in M.chain(df, "s", "d", hops).collect()} == want
    whole = {r["s"]: (r["target"], r["n"]) for r in M.chain(df, "s", "d", None).collect()}
    assert whole[1] == (60, 59) and whole[59] == (60, 1) and {whole[k][0] for k in (100, 101, 102, 103)} == {None}
    plan = M.chain(df, "s", "d", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1  # of four; the jumps of 2, 4 and 8 edges are written tables


def _cosines(weights) -> dict:
    own: dict = {}
    for r in weights.collect():
        own.setdefault(r["id"], {})[r["term"]] = (r["weight"], r["df"], r["n"])
    out = {}
    for a in own:
        for b in own:
            both = own[a].keys() & own[b].keys()
            if a < b and any(own[a][t][1] <= max(2, own[a][t][2] // 2) for t in both):
                out[a, b] = sum(own[a][t][0] * own[b][t][0] for t in both)
    return out


def test_pairs_of_common_terms_only(spark):
    """Documents that share only terms of more than half of all documents are no pair, however alike."""
    docs = [(k, "alpha beta " * 5 + f"own{k:02}") for k in range(6)] + [(10, "gamma delta"), (11, "gamma delta"), (12, "epsilon zeta")]
    weights = X.tfidf(spark.createDataFrame(docs, "id long, text string"), "id", F.col("text"))
    for most in (0.0, 1.0):
        got = {(r["a"], r["b"]) for r in X.tfidf_pairs(weights, 0.35, most_meetings=most).collect()}
        assert got == {p for p, c in _cosines(weights).items() if c >= 0.35} == {(10, 11)}


@pytest.mark.parametrize("most", [0.0, 1.0])
def test_many_topics(spark, most):
    """Both plans give the pairs of brute force; of many topics most pairs of documents are never compared."""
    rnd = random.Random(6)
    docs = [(20 * t + k, " ".join(rnd.choices([f"topic{t:02}word{j}" for j in range(30)], k=25) + ["every", "where"])) for t in range(20) for k in range(20)]
    weights = X.tfidf(spark.createDataFrame(docs, "id long, text string"), "id", F.col("text")).cache()
    want = {p: c for p, c in _cosines(weights).items() if c >= 0.5}
    got = {(r["a"], r["b"]): r["cosine"] for r in X.tfidf_pairs(weights, 0.5, block=30, most_meetings=most).collect()}
    assert got.keys() == want.keys() and all(abs(c - want[p]) < 1e-9 for p, c in got.items()) and len(got) > 100
    multiplied = X.block_products(weights, 0.5, 30, 5000).where("a IS NULL").agg(F.sum("n")).first()[0]
    assert multiplied < 0.35 * len(docs) ** 2


def test_pairs_of_blocks_copy_nothing(spark, monkeypatch):
    """Pairs of blocks are a product of a written table with itself: no shuffle carries a document once per block, and cosines come with the pairs."""
    rnd = random.Random(3)
    docs = [(k, " ".join(rnd.choices([f"word{j:02}" for j in range(60)], k=rnd.randrange(1, 40)))) for k in range(150)] + [(500 + k, "one and the same text") for k in range(9)] + [(900, ""), (901, "   ")]
    weights = X.tfidf(spark.createDataFrame(docs, "id long, text string"), "id", F.col("text")).cache()
    want = {p: c for p, c in _cosines(weights).items() if c >= 0.4}
    for given in (weights, weights.drop("term_id")):
        out = X.block_products(given, 0.4, 20, 100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan and "FlatMapGroups" not in plan
        rows = [(r["a"], r["b"], r["cosine"]) for r in out.where("a IS NOT NULL").collect()]
        assert len(rows) == len(want) > 30 and all(abs(c - want[a, b]) < 1e-9 for a, b, c in rows)
    blocks = out.where("a IS NULL").count()
    assert blocks in {n * (n + 1) // 2 for n in range(6, 16)}  # each pair of blocks once
    monkeypatch.setattr(X, "FEW_DOCUMENTS", 10)
    monkeypatch.setattr(X, "MEETINGS", 0)
    got = {(r["a"], r["b"]): r["cosine"] for r in X.tfidf_pairs(weights, 0.4, block=20, most_meetings=1.0).collect()}
    assert got.keys() == want.keys()


@pytest.mark.parametrize("dense", [1, 60, 10**9])
def test_few_pairs_are_added_up_in_full(spark, dense, monkeypatch):
    """Documents of one language share common terms: what these can add is bounded, and only the pairs that can reach the threshold are added up in full."""
    monkeypatch.setattr(X, "STEP", 300)
    rnd = random.Random(8)
    common, rare = [f"common{j:02}" for j in range(60)], [f"rare{j:04}" for j in range(4000)]
    docs = [(k, " ".join(rnd.choices(common, k=rnd.randrange(2, 30)) + rnd.choices(rare, k=rnd.randrange(60)))) for k in range(240)]
    docs += [(1000 + k, t + " " + " ".join(rnd.choices(rare, k=15))) for k, t in docs[:40]] + [(2000, "common01 common02"), (2001, "common02 common01 common01")]
    weights = X.tfidf(spark.createDataFrame(docs, "id long, text string"), "id", F.col("text")).cache()
    want = {p: c for p, c in _cosines(weights).items() if c >= 0.35}
    rows = X.block_products(weights, 0.35, 100, dense).collect()
    got = {(r["a"], r["b"]): r["cosine"] for r in rows if r["a"] is not None}
    assert got.keys() == want.keys() and len(got) == sum(r["a"] is not None for r in rows) > 30 and all(abs(c - want[p]) < 1e-9 for p, c in got.items())
    assert len(got) <= sum(r["n"] for r in rows if r["a"] is None) < 0.25 * len(docs) ** 2 / 2


def test_series_read_texts_once(spark, tmp_path):
    """Headlines are cut once, not again for either end of an edge."""
    docs = [(k, "s", f"Weekly threats {k}\nbody") for k in range(4)] + [(k, "s", f"Other {'abcdef'[k - 10]}\nbody") for k in range(10, 16)] + [(20, None, "Weekly threats\nbody")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "docs"))
    edges = spark.createDataFrame([(0, 1), (1, 3), (2, 10), (10, 11), (3, 20)], "a long, b long")
    out = X.suppress_series(edges, spark.read.parquet(str(tmp_path / "docs")), "doc_id", "source", F.split_part("text", F.lit("\n"), F.lit(1)))
    assert {(r["a"], r["b"]) for r in out.collect()} == {(2, 10), (10, 11), (3, 20)}
    assert str(tmp_path) not in "".join(out.inputFiles())


def test_looked_at_documents_are_bounded(spark, monkeypatch):
    """The share of pairs that meet is found from a number of documents that doesn't grow with the table."""
    weights = X.tfidf(spark.range(3000).select("id", F.expr("concat('word', id % 50, ' own', id)").alias("text")), "id", F.col("text")).cache()
    seen = []
    monkeypatch.setattr(X, "leading", lambda part, threshold, old=X.leading: (seen.append(part.select("id").distinct().count()), old(part, threshold))[1])
    share, documents = X._shared(weights, 0.35, most=100)
    assert documents == 3000 and 50 < seen[0] < 200 and 0.005 < share < 0.05


def test_near_pairs_as_brute_force(spark):
    """Fingerprints in crowds that agree in many bits, with copies and near copies."""
    rnd = random.Random(11)
    flip = lambda v, n: v ^ sum(1 << b for b in rnd.sample(range(64), n))
    centres = [rnd.getrandbits(64) for _ in range(3)]
    some = [flip(rnd.choice(centres), rnd.randrange(3, 16)) for _ in range(350)] + [rnd.getrandbits(64) for _ in range(40)]
    some += [flip(v, rnd.randrange(0, 9)) for v in some[:150]] + [0, (1 << 64) - 1, 63]
    signed = [v - (1 << 64) if v >> 63 else v for v in some]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    least: dict = {}
    for k, v in enumerate(some):
        least.setdefault(v, k)
    distinct = list(least.items())
    want = {tuple(sorted((a, b))) for i, (v, a) in enumerate(distinct) for w, b in distinct[:i] if (v ^ w).bit_count() <= 6} | {(least[v], k) for k, v in enumerate(some) if least[v] != k}
    got = [(r["a"], r["b"]) for r in near.near_pairs(df, "id", "fp", 6).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
    assert near.near_pairs(df.where("false"), "id", "fp").count() == 0
    groups = df.groupBy("fp").agg(F.min("id").alias("id"))
    for chosen in ([(list(range(64)), 6)], [(list(range(20)), 2), (list(range(20, 40)), 1), (list(range(40, 64)), 1)], [(list(range(10)), 6)]):
        met = near.meetings(groups, "fp", chosen).where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= 6).select("a", "b").distinct()
        if len(chosen[0][0]) < 64:  # a ball of six of 64 bits isn't enumerated
            assert {tuple(r) for r in met.collect()} == {p for p in want if some[p[0]] != some[p[1]]}


def test_crowds_are_compared_in_blocks(spark, monkeypatch):
    """Crowds agree in so many bits that keys would bring all together; blocks of them are compared in place, and each pair is one row."""
    rnd = random.Random(12)
    crowd = [0x5A5A5A5A5A5A5A5A ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for _ in range(400)] + [0, (1 << 64) - 1, 1 << 63]
    signed = [v - (1 << 64) if v >> 63 else v for v in crowd]
    least: dict = {}
    for k, v in enumerate(crowd):
        least.setdefault(v, k)
    want = sorted([tuple(sorted((a, b))) for v, a in least.items() for w, b in least.items() if a < b and (v ^ w).bit_count() <= 6] + [(least[v], k) for k, v in enumerate(crowd) if least[v] != k])
    monkeypatch.setattr(near, "LEAST_BLOCK", 60)
    monkeypatch.setattr(near, "HELD", 500)
    monkeypatch.setattr(near, "TILE", (7, 24))
    out = near.near_pairs(spark.createDataFrame(list(enumerate(signed)), "id int, fp long"), "id", "fp", 6)
    assert out.schema["a"].dataType.simpleString() == "int" and sorted((r["a"], r["b"]) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan.split("Union")[1].split("CartesianProduct")[0]
    # ids that aren't whole numbers keep to keys
    out = near.near_pairs(spark.createDataFrame([(f"d{k:04}", v) for k, v in enumerate(signed)], "id string, fp long"), "id", "fp", 6)
    assert sorted((int(r["a"][1:]), int(r["b"][1:])) for r in out.collect()) == want


def test_meetings_once_and_never_broadcast(spark):
    """A pair that meets at many points is one row, also with all bits set; keys are many times the table and must not pass through the driver."""
    crowd = [v - (1 << 64) if v >> 63 else v for v in ((0b1011 << 60) ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a, 64, 7))]
    groups = spark.createDataFrame([(v, k) for k, v in enumerate(dict.fromkeys([*crowd, 0, -1, -(1 << 63), (1 << 63) - 1]))], "fp long, id long")
    for chosen in (near.plan(groups, "fp", 6), [(list(range(22)), 2), (list(range(22, 43)), 1), (list(range(43, 64)), 1)]):
        met = near.meetings(groups, "fp", chosen)
        rows = [(r["a"], r["b"]) for r in met.collect()]
        assert len(rows) == len(set(rows)) > 1000
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_greedy_rounds(spark, monkeypatch):
    """A chain takes as many rounds as it has kept rows; all rows of a crowd but the first go at once."""
    chain = [(1 << 4 * k) - 1 for k in range(12)]
    crowd = [0xF0F0F0F0F0F0F0F | 1 << 63 ^ (1 << b) for b in range(20)]
    prints = [v - (1 << 64) if v >> 63 else v for v in [*chain, *crowd, crowd[0]]]
    monkeypatch.setattr(X, "simhash_column", lambda text: text.cast("long"))
    got = {r["id"]: r["kept"] for r in X.greedy_kept(spark.createDataFrame([(k, str(v)) for k, v in enumerate(prints)], "id long, t string"), "id", F.col("t")).collect()}
    kept = []
    for k, v in enumerate(prints):
        if not any(((v ^ prints[j]) % (1 << 64)).bit_count() <= 6 for j in kept):
            kept.append(k)
    assert {k for k, v in got.items() if v} == set(kept) and len(got) == len(prints)


@pytest.mark.parametrize("edges", [0, 100_000])
def test_greedy_in_batches(spark, monkeypatch, edges):
    """Crowds are dropped by what was kept before: later batches list hardly any pairs, and the choice is that of one pass in the order of ids."""
    rnd = random.Random(13)
    flip = lambda v, n: v ^ sum(1 << b for b in rnd.sample(range(64), n))
    centres = [rnd.getrandbits(64) for _ in range(4)]
    prints = [flip(rnd.choice(centres), rnd.randrange(5)) for _ in range(500)] + [rnd.getrandbits(64) for _ in range(50)]
    prints = [v - (1 << 64) if v >> 63 else v for v in prints + prints[:30]]
    monkeypatch.setattr(X, "simhash_column", lambda text: text.cast("long"))
    monkeypatch.setattr(X, "FIRST_BATCH", 60)
    monkeypatch.setattr(X, "GROWTH", 2)
    monkeypatch.setattr(X, "TASK_EDGES", edges)
    listed = []
    monkeypatch.setattr(X, "_dropped", lambda pairs, old=X._dropped: (listed.append(pairs.count()), old(pairs))[1])
    got = {r["id"]: r["kept"] for r in X.greedy_kept(spark.createDataFrame([(3 * k, str(v)) for k, v in enumerate(prints)], "id long, t string"), "id", F.col("t")).collect()}
    kept: list = []
    for k, v in enumerate(prints):
        if not any(((v ^ prints[j]) % (1 << 64)).bit_count() <= 6 for j in kept):
            kept.append(k)
    assert {k for k, v in got.items() if v} == {3 * k for k in kept} and len(got) == len(prints)
    assert len(listed) >= 3 and sum(listed[1:]) < 100 < listed[0]


def test_crowded_bits_are_left_out():
    """Bits in which a crowd agrees get no segment or a small radius, so few of the crowd meet."""
    rnd = random.Random(5)
    crowd = [0xFFFFFFFF00000000 | rnd.getrandbits(32) for _ in range(1000)]
    chosen = near.segments(crowd, 10**6, 6)
    assert sum(r + 1 for _, r in chosen) == 7
    assert sum(b < 32 for bits, _ in chosen for b in bits) >= 0.6 * sum(len(bits) for bits, _ in chosen)
    met = lambda cut: sum(any(((a ^ b) & sum(1 << x for x in bits)).bit_count() <= r for bits, r in cut) for i, a in enumerate(crowd) for b in crowd[:i])
    bands = [(list(range(64 * k // 7, 64 * (k + 1) // 7)), 0) for k in range(7)]
    assert met(chosen) < 0.3 * met(bands)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_dense_pairs(spark, spread, monkeypatch):
    """Equal to brute force with and without clusters; with clusters few pairs are compared."""
    monkeypatch.setattr(dense, "TILE", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12))
    rows = [(k, (centres[k % 30] + spread * rng.normal(size=12)).tolist()) for k in range(600)] + [(1000, centres[0].tolist()), (1001, (2 * centres[0]).tolist()), (1002, None), (1003, []), (1004, [1.0]), (1005, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    unit = {k: np.array(v) / max(np.linalg.norm(v), 1e-12) for k, v in rows if v is not None and len(v) == 12}
    want = {(a, b): float(unit[a] @ unit[b]) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.85}
    got = {(r["a"], r["b"]): r["cosine"] for r in dense.dense_pairs(df, "vec_id", "embedding", 0.85, block=70).collect()}
    assert got.keys() == want.keys() and all(abs(c - want[p]) < 1e-9 for p, c in got.items()) and len(want) > 20
    multiplied = dense.compared(df, "vec_id", "embedding", 0.85, 70).where("a IS NULL").agg(F.sum("cosine")).first()[0]
    assert multiplied < (0.25 if spread < 1 else 1.2) * len(unit) ** 2 / 2
    assert dense.dense_pairs(df.where("false"), "vec_id", "embedding", 0.85).count() == 0


@pytest.mark.parametrize("threshold", [95, 85, 80, 70, 55])
def test_fuzzy_candidates_lose_nothing(spark, threshold):
    """Every pair that reaches the threshold is a candidate, by ratio and by part; candidates are fewer than all pairs."""
    rnd = random.Random(threshold)
    word = lambda a, b: "".join(rnd.choice("abcdefghij ") for _ in range(rnd.randrange(a, b)))
    ours = {word(1, 12) for _ in range(40)} | {"abc", "é", "aaaa"}
    theirs = {word(1, 30) for _ in range(60)} | {"xx", "aaaaaaab"}
    for w in list(ours)[:25]:
        own = list(w)
        own[rnd.randrange(len(own))] = rnd.choice(["", "q", "ab"])
        theirs |= {"".join(own), word(0, 8) + "".join(own) + word(0, 8)}
    theirs -= {""}
    a, b = spark.createDataFrame([(w,) for w in ours], "w string"), spark.createDataFrame([(v,) for v in theirs], "v string")
    for near_of, score in ((M._near_texts, fuzzy.ratio), (M._near_parts, fuzzy.partial_ratio)):
        got = {(r["w"], r["v"]) for r in near_of(a, "w", b, "v", threshold).collect()}
        assert {(w, v) for w in ours for v in theirs if score(w, v) >= threshold} <= got
        assert threshold < 80 or len(got) < 0.6 * len(ours) * len(theirs)


@pytest.mark.parametrize("few", [0, 32])
def test_watch_list_as_a_table(spark, few, monkeypatch):
    monkeypatch.setattr(M, "FEW_TERMS", few)
    watch = [(1, "Acme Corp", "acme.example", "acme, ac"), (2, "ab", None, "globex"), (3, " Initech ", "", "printer,, red stapler"), (4, "ab", "globex.test", None), (5, "Hooli", None, "hool,hooli xyz")]
    victims = [(1, "corp acme", None), (2, "The Acne Corporation", "x"), (3, None, "acme.exampl"), (4, "globex", "globex.tests"), (5, "INITECH inc", "initech"), (6, "a red stapler firm", None), (7, "", ""), (1, "corp acme", None), (8, "the hooli group", None), (9, "  hooli", "ab")]
    w = spark.createDataFrame(watch, "watch_id int, name string, domain string, keywords string")
    v = spark.createDataFrame(victims, "id long, name string, domain string")
    for threshold in (85, 70, 60):
        want = []
        for i, n, d, k in watch:
            for r, vn, vd in victims:
                words = [x.strip().lower() for x in (k or "").split(",") if x.strip()]
                m = fuzzy.match_label(n.lower().strip(), (d or "").lower().strip() or None, words, vn, vd, threshold)
                want += [(i, r, m)] if m else []
        got = [tuple(r) for r in M.watch_fuzzy(v, "id", "name", "domain", w, threshold).collect()]
        assert sorted(got) == sorted(want) and len(want) > 5
