import random
from collections import Counter

import pytest
import xxhash
from fixtures import corpus, frame

from cinderlake.llm import simhash


def brute_print(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[k : k + size] for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, most=4):
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most:
                label[root(a)] = root(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(k)] = min(doc, least.get(root(k), doc))
    return Counter((doc, f"{p:016x}", least.get(root(k))) for k, ((doc, _), p) in enumerate(zip(rows, prints)))


def edited(n=60):
    words = [f"w{k * k % 997}" for k in range(400)]
    out = []
    for k in range(n):
        own = list(words)
        own[(k * 7) % 400] = f"new{k}"
        out.append((1000 + k, " ".join(own)))
    return out


@pytest.mark.parametrize("cap", [4096, 3])
def test_as_brute_force(spark, cap, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_AT_POINT", cap)
    rows = corpus(1) + edited()
    got = Counter(map(tuple, simhash.op6_simhash(frame(spark, rows)).collect()))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len({f for _, f, _ in got})


@pytest.mark.parametrize("cap", [4096, 4])
def test_keep_one(spark, cap, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_AT_POINT", cap)
    rows = edited(40) + [(1, "a quite different text " * 3), (2, "one more that shares nothing with others"), (3, None)]
    left = simhash.keep_one(frame(spark, rows))
    assert "key" in left.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 1000]


def test_empty(spark):
    assert simhash.op6_simhash(frame(spark, []).where("false")).count() == 0


def pair(rnd, k, changed):
    """Two documents of 103 words (99 shingles): the second has its last ``changed`` words new."""
    own = [f"p{k}x{rnd.randrange(10**6)}" for _ in range(103)]
    return " ".join(own), " ".join(own[: 103 - changed] + [f"q{k}y{j}" for j in range(changed)])


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_keep_one_at_the_similarity(spark, block, monkeypatch):
    """Pairs at 0.8 and more lose one document, pairs below lose none, as all pairs say."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
    rnd = random.Random(5)
    rows = [(2 * k + x, t) for k in range(60) for x, t in enumerate(pair(rnd, k, 7 + k % 10))]
    rows += [(500 + k, t) for k, (_, t) in enumerate(corpus(3)) if k > 4] + edited(12)
    shingles = {}
    for d, t in rows:
        w = (t or "").lower().split()
        shingles[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = {d: d for d in shingles}
    for a in label:
        for b in label:
            if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {d: lo if x == hi else x for d, x in label.items()}
    got = sorted(r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect())
    assert got == sorted(d for d in label if label[d] == d)
    assert sum(2 * k + 1 in got for k in range(60)) == 30


def test_recall_at_the_similarity(spark):
    """Of pairs whose similarity is from 0.8 to 0.85, scattered changes included, nearly all lose one document."""
    rnd = random.Random(11)
    rows, near = [], set()
    for k in range(400):
        n = rnd.randrange(90, 400)
        own = [f"p{k}x{j}" for j in range(n)]
        other = list(own)
        for j in rnd.sample(range(n), max(1, n // 46)):
            other[j] = f"q{k}y{j}"
        a, b = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (own, other))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            near.add(2 * k + 1)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    left = {r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert len(near) > 100 and len(near - left) >= 0.97 * len(near)
    assert {d for d, _ in rows if d % 2 == 0} <= left


def test_suspects_lose_no_pair(spark):
    """Documents left out before fingerprints are made share less than the similarity with all others."""
    rows = edited(12) + [(500 + k, t) for k, (_, t) in enumerate(corpus(3)) if k > 4]
    shingles = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        shingles[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    held = {r["doc_id"] for r in simhash.suspects(frame(spark, rows), 5, 0.8, 4).collect()}
    assert len(held) < len(rows)
    for a in shingles.keys() - held:
        assert all(a == b or len(shingles[a] & shingles[b]) < 0.8 * len(shingles[a] | shingles[b]) for b in shingles)
