import hashlib
import random
from collections import Counter

import pytest
from fixtures import corpus, frame

from cinderlake.llm import suffix_dedup


def covered(texts, length):
    count = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        yield gone


def brute(rows, length, least):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc, _), t, gone, more in zip(rows, texts, covered(texts, length), covered(texts, least)):
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest(), sum(more)))
    return Counter(out)


@pytest.mark.parametrize(("seed", "crowd"), [(1, 2000), (2, 2000), (3, 2), (4, 3)])
def test_as_brute_force(spark, seed, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "RANGE_KEYS", 100)
    monkeypatch.setattr(suffix_dedup, "RANGE_STRINGS", 500)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 5000)
    rows = corpus(seed, 60)
    got = suffix_dedup.repeated_bytes(frame(spark, rows), 100, 60)
    got = got.selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256", "n_repeated").collect()
    assert Counter(map(tuple, got)) == brute(rows, 100, 60)
    assert sum(r[2] for r in got) > 1000


def test_contract_length(spark):
    rows = corpus(5, 60, 300)
    assert Counter(map(tuple, suffix_dedup.op1_suffix_dedup(frame(spark, rows)).collect())) == brute(rows, 400, 256)


@pytest.mark.parametrize("least", [33, 100])
def test_any_shorter_length(spark, least):
    rows = corpus(6, 40) + [(900, "ab" * 400), (901, "x" * 99), (902, "x" * 100), (903, "x" * 101)]
    got = suffix_dedup.repeated_bytes(frame(spark, rows), 100, least)
    got = got.selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256", "n_repeated").collect()
    assert Counter(map(tuple, got)) == brute(rows, 100, least)


def test_whole_long_text(spark):
    """A text over a chunk's size is one document; what two such texts share is found at its place."""
    rnd = random.Random(1)
    own = ["".join(rnd.choices("abcdefgh ", k=2_300_000)) for _ in range(2)]
    shared = "".join(rnd.choices("ijkl", k=5000))
    rows = [(1, own[0][:2_000_000] + shared + own[0][2_000_000:]), (2, shared[1000:1399] + own[1]), (3, own[1][:100] + shared[7:450])]
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_bytes(frame(spark, rows)).collect()}
    assert got[1]["spans"][0]["start"] == 2_000_007 and got[1]["n_removed"] == got[3]["n_removed"] == 443
    assert got[2]["n_removed"] == 0 and got[2]["n_repeated"] == 399 and got[1]["n_repeated"] == 842


def test_empty(spark):
    assert suffix_dedup.op1_suffix_dedup(frame(spark, []).where("false")).count() == 0
