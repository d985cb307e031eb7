import hashlib
from collections import Counter, defaultdict

import pytest
from fixtures import corpus, frame

from cinderlake.llm import substring_words


def brute(rows, window=20):
    words = [(-(1 << 63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    where = defaultdict(list)
    for n, (i, w) in enumerate(words):
        for s in range(len(w) - window + 1):
            where[tuple(w[s : s + window])].append((i, n, s))
    out = []
    for n, ((i, w), (doc, _)) in enumerate(zip(words, rows)):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if any(d < i or m == n and x < s for d, m, x in where[tuple(w[s : s + window])]):
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(substring_words, "RANGE_KEYS", 2000)
    rows = corpus(seed)
    got = substring_words.op7_substring(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute(rows)
    assert sum(r[2] for r in got) > 500


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join((a, b)[bin(k).count("1") & 1] for k in range(n))


def test_words_of_any_shape(spark, monkeypatch):
    """Words whose sums of powers agree modulo 2 ** 64, whatever the base, are different words; so are runs of such words."""
    monkeypatch.setattr(substring_words, "RANGE_KEYS", 50)
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    tail = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, thue_morse(2048, "x ", "y ")), (4, thue_morse(2048, "y ", "x ")), (5, ("v" * 100_000 + " ") * 30), (6, ("v" * 99_999 + "u ") * 30), (7, f"{two} {tail}")]
    got = substring_words.op7_substring(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute(rows)
    assert {r[0]: r[2] for r in got if r[0] in (1, 2, 7)} == {1: 0, 2: 0, 7: 20}


def test_long_text(spark):
    """A text of 300,000 words with one repeated passage."""
    words = [f"w{k}" for k in range(300_000)]
    rows = [(1, " ".join(words)), (2, "start " + " ".join(words[250_000:250_040]) + " end")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_words.op7_substring(frame(spark, rows)).collect()}
    assert got == {1: (300_000, 0), 2: (42, 40)}


def test_empty(spark):
    assert substring_words.op7_substring(frame(spark, []).where("false")).count() == 0
