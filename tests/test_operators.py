import gzip
import random

import pytest
from pyspark.sql import functions as F

from cinderlake.operators import graph, ingest, matching
from cinderlake.operators import text as X
from cinderlake.sources import markdown, readers
from cinderlake.streaming import microbatch as B


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(None, 3), (7, 7)]
    label = {n: n for e in edges for n in e if n is not None}
    for _ in label:
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {n: c for n, c in label.items() if any(n in e and e[0] != e[1] and None not in e for e in edges)}


def test_components_without_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_first_wins_with_nulls(spark):
    rows = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("x", 3, "c")], "k string, seq int, v string")
    assert sorted(r["v"] for r in ingest.first_wins(rows, ["k"], ["seq"]).collect()) == ["a", "c"]


def test_evidence(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "id int, p string")
    current, past = ingest.evidence(old, new, ["id"], "p")
    assert sorted(map(tuple, current.collect())) == [(1, "a"), (2, "c"), (3, "d")] and list(map(tuple, past.collect())) == [(2, "b")]


def test_near_pairs_as_brute_force(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(10)]
    prints = [(k, (b := base[k % 10] ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5)))) - (1 << 64) * (b >> 63)) for k in range(60)]
    df = spark.createDataFrame(prints, "id long, fp long")
    got = graph.connected_components(X.near_pairs(df, "id", "fp", 6), "a", "b").collect()
    label = dict(prints and [(k, k) for k, _ in prints])
    for _ in prints:
        for a, x in prints:
            for b, y in prints:
                if ((x ^ y) % (1 << 64)).bit_count() <= 6:
                    label[a] = label[b] = min(label[a], label[b])
    assert dict(map(tuple, got)) == {k: c for k, c in label.items() if sum(v == c for v in label.values()) > 1}


def test_greedy_as_sequential(spark):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(50)]
    base = [[rnd.choice(words) for _ in range(60)] for _ in range(4)]
    docs = []
    for k in range(40):
        own = list(base[k % 4])
        for _ in range(rnd.randrange(6)):
            own[rnd.randrange(60)] = rnd.choice(words)
        docs.append((k, " ".join(own)))
    from cinderlake.functions.text import simhash64

    kept: list = []
    for k, t in docs:
        fp = simhash64(t)
        if all(((fp ^ other) % (1 << 64)).bit_count() > 6 for _, other in kept):
            kept.append((k, fp))
    got = X.greedy_kept(spark.createDataFrame(docs, "id long, t string"), "id", F.col("t")).where("kept").collect()
    assert sorted(r["id"] for r in got) == [k for k, _ in kept]


def test_range_lookup(spark):
    spans = spark.createDataFrame([(1, 0, 9), (2, 5, 25), (3, 30, 30)], "s int, lo long, hi long")
    points = spark.createDataFrame([(k,) for k in (0, 7, 24, 26, 30)], "at long")
    got = matching.range_lookup(points, "at", spans, "lo", "hi", 10).select("at", "s").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (7, 1), (7, 2), (24, 2), (30, 3)]


def test_resolve(spark):
    actors = spark.createDataFrame([(1, "LockBit"), (2, "Black Basta"), (3, "Twin"), (4, "twin")], "actor_id int, name string")
    aliases = spark.createDataFrame([("ABCD", 1)], "alias string, actor_id int")
    names = spark.createDataFrame([(n,) for n in ("lockbit ", "abcd", "blackbasta", "TWIN", "nobody at all")], "n string")
    got = {r["k"]: (r["rung"], r["id"]) for r in matching.resolve(names, "n", actors, "actor_id", "name", aliases).collect()}
    assert got == {"lockbit": ("exact", 1), "abcd": ("alias", 1), "blackbasta": ("fuzzy", 2), "twin": ("ambiguous", None), "nobody at all": ("unknown", None)}


GANGS = """# list
| Name | Status | User | Contact | RSS |
|---|---|---|---|---|
| [Acme (Dark)](http://acme.onion) | online | - | https://t.me/acme - a@b.org | - |
| ransomfeed | x |
| Other list | Status |
|---|---|
| Beta | offline |
text
| not in a table |
"""


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text(GANGS)
    got = markdown.parsed(spark, str(tmp_path), markdown.gangs, "name,url,status,credentials,comms_raw,rss").orderBy("pos")
    assert [(r["name"], r["url"], r["status"]) for r in got.collect()] == [("Acme", "http://acme.onion", "ONLINE"), ("Beta", "", "OFFLINE")]
    kinds = got.select(markdown.contacts(F.col("comms_raw")).alias("c")).first()["c"]
    assert [(c["kind"], c["value"]) for c in kinds] == [("telegram", "https://t.me/acme"), ("email", "a@b.org")]
    assert markdown.telegram("| Telegram | S | Name | T |\n|--|--|--|--|\n| [x](http://t.me/x) | valid | X | ddos |\n| none | v | Y | z |")[0]["status"] == "VALID"


def test_feeds(spark, tmp_path):
    with gzip.open(tmp_path / "asn.tsv.gz", "wt") as f:
        f.write("1.0.0.0\t1.0.0.255\t13335\tUS\tX\nbad line\n2.0.0.0\t2.0.0.9\t1\tUS\tY\n")
    assert list(map(tuple, readers.asn_spans(spark, str(tmp_path / "asn.tsv.gz")).collect())) == [("1.0.0.0", "1.0.0.255")]
    (tmp_path / "tor").write_text("ExitNode X\nExitAddress 5.6.7.8 2024\n")
    assert readers.exit_addresses(spark, str(tmp_path / "tor")).first()[0] == "5.6.7.8"
    (tmp_path / "ms.csv").write_text("prefix,x\n10.0.0.0/8,a\n<<<<<<< HEAD\n11.0.0.0/8,b\n")
    assert [r[0] for r in readers.column_of(spark, str(tmp_path / "ms.csv"), 0).collect()] == ["10.0.0.0/8", "11.0.0.0/8"]
    with pytest.raises(readers.FeedMissingError):
        readers.column_of(spark, str(tmp_path / "none.csv"), 0)


def test_landed(spark, tmp_path):
    (tmp_path / "v.json").write_text('[{"victim":"A","attackdate":"2024-01-02 03:04:05","country":"us","domain":""},{"group_name":"g"}]')
    got = readers.victims(spark, str(tmp_path / "v.json")).collect()
    assert [(r["victim_name"], r["domain"], r["country"]) for r in got] == [("A", None, "US"), ("", None, None)]
    (tmp_path / "p.json").write_text('{"result":[{"address":"a","family":"f","transactions":[{"hash":"h","time":1,"amount":150000000,"amountUSD":2.5},{"hash":"h","time":2,"amount":1,"amountUSD":1}]}]}')
    tx = readers.payments(spark, str(tmp_path / "p.json")).collect()
    assert len(tx) == 1 and str(tx[0]["btc"]) == "1.50000000"


def test_bundle(spark, tmp_path):
    (tmp_path / "b.json").write_text(
        '{"objects":[{"type":"intrusion-set","id":"i1","name":"G","aliases":["H"],"external_references":[{"source_name":"mitre-attack","external_id":"G1"}]},'
        '{"type":"tool","id":"t1","name":"T","revoked":true},{"type":"attack-pattern","id":"a1","name":"P","modified":"2024-01-01T00:00:00Z"},'
        '{"type":"relationship","id":"r","relationship_type":"uses","source_ref":"i1","target_ref":"a1"}]}'
    )
    objects = readers.bundle(spark, str(tmp_path / "b.json"))
    nodes = readers.bundle_nodes(objects)
    assert {(r["id"], r["kind"], r["external_id"]) for r in nodes.collect()} == {("i1", "group", "G1"), ("a1", "technique", None)}
    assert matching.route_edges(readers.bundle_edges(objects), nodes)["group>technique"].count() == 1
    assert readers.modified_since(nodes, "2024-06-01").count() == 1


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link> http://x </link><description>d</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item></channel></rss>")
    row = readers.feed_items(spark, str(tmp_path / "f.xml")).first()
    assert (row["title"], row["link"], str(row["published"])) == ("A", "http://x", "2024-01-02 03:04:05")


def test_increments(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    seen = lambda: sorted(r["id"] for r in spark.read.parquet(out).collect())
    for part in (range(5), range(5, 8)):
        spark.createDataFrame([(k,) for k in part], "id long").write.mode("append").parquet(src)
        B.run_available(B.read_increments(spark, src, "id long"), mark, B.append_matches(out, lambda r: r.where("id > 2"), ["id"]))
    assert seen() == [3, 4, 5, 6, 7]


def test_incremental_pairs(spark):
    frame = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} int")
    match = lambda t, r: t.join(r, (F.col("v") - F.col("t")) % 2 == 0)
    known = spark.createDataFrame([(3, 1)], "t int, v int")
    got = B.incremental_pairs(frame("t", [1]), frame("t", [3]), frame("v", [1, 2, 3]), frame("v", [3]), match, known, ["t", "v"])
    assert sorted(map(tuple, got.collect())) == [(1, 3), (3, 3)]


def test_tfidf_pairs_as_brute_force(spark):
    rnd = random.Random(2)
    words = [f"term{k}" for k in range(40)]
    docs = [(k, " ".join(rnd.choices(words, k=12))) for k in range(40)]
    docs += [(100 + k, t.replace("term1 ", "term2 ")) for k, t in docs[:10]]
    w = X.tfidf(spark.createDataFrame(docs, "id long, t string"), "id", F.col("t")).collect()
    vectors: dict = {}
    for r in w:
        vectors.setdefault(r["id"], {})[r["term"]] = r["weight"]
    want = {(a, b) for a in vectors for b in vectors if a < b and sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items()) >= 0.7}
    got = X.tfidf_pairs(spark.createDataFrame(w), 0.7).collect()
    assert {(r["a"], r["b"]) for r in got} == want and want


@pytest.mark.parametrize("threshold", [0.7, 0.35])
def test_tfidf_pairs_with_repeated_terms(spark, threshold):
    """Short texts against texts with repeated lines: a term in the rest of one may lead the other."""
    rnd = random.Random(4)
    words = [f"term{k}" for k in range(30)]
    docs = [(k, " ".join(rnd.choices(words, k=12))) for k in range(40)]
    for k in range(20):
        rare, often = f"rare{k}", words[k]
        docs += [(100 + 2 * k, f"{rare} {often}"), (101 + 2 * k, f"{rare} " + f"{often} " * 15)]
    w = X.tfidf(spark.createDataFrame(docs, "id long, t string"), "id", F.col("t")).collect()
    vectors: dict = {}
    for r in w:
        vectors.setdefault(r["id"], {})[r["term"]] = r["weight"]
    want = {(a, b) for a in vectors for b in vectors if a < b and sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items()) >= threshold}
    got = X.tfidf_pairs(spark.createDataFrame(w), threshold).collect()
    assert {(r["a"], r["b"]) for r in got} == want and (100, 101) in want


def test_resolve_rounded_score(spark):
    """Lengths 13 and 16 score round(89.66) = 90; without a threshold names count from 85 on."""
    long, nearly = "abcdefghijklmnop", "q" * 17 + "rst"
    actors = spark.createDataFrame([(1, long), (2, nearly)], "actor_id int, name string")
    aliases = spark.createDataFrame([], "alias string, actor_id int")
    names = spark.createDataFrame([(long[:13],), ("q" * 17 + "uvw",)], "n string")
    found = lambda **kw: {r["k"]: r["id"] for r in matching.resolve(names, "n", actors, "actor_id", "name", aliases, **kw).collect()}
    assert found(threshold=90) == {long[:13]: 1, "q" * 17 + "uvw": None}
    assert found() == {long[:13]: 1, "q" * 17 + "uvw": 2}
