import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import corpus, frame
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cinderlake.llm import packing


@given(st.integers(0, 10**6), st.integers(0, 12))
def test_lengths(tokens, power):
    parts = packing.piece_lengths(tokens, 1 << power)
    assert sum(parts) == tokens and all(p & (p - 1) == 0 and p <= 1 << power for p in parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_round_trip(spark, seed):
    rows = corpus(seed) + [(900, "Ünïcode — 漢字 🙂\n\n  x's <|endoftext|> 12345"), (901, "a" * 3000)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = sorted([tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows])
    got = packing.pack(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True).collect()
    docs = defaultdict(dict)
    for r in got:
        assert r["length"] == len(r["ids"]) <= 2048 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        docs[r["doc_id"], r["doc_tokens"]].setdefault(r["start"], []).append(list(r["ids"]))
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert sum(r["length"] for r in got) == sum(map(len, want))
    unique = {k: v for k, v in docs.items() if all(len(x) == 1 for x in v.values())}
    assert len(unique) > 30
    for parts in unique.values():
        assert sum((parts[s][0] for s in sorted(parts)), []) in want


def test_long_text(monkeypatch):
    import regex

    words = packing.WordTokens(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pattern, text = regex.compile(words.pattern), "some words, again " * 70_000
    assert packing.token_bytes(text, words, pattern) == b"".join(map(words.__getitem__, pattern.findall(text)))


def test_empty(spark):
    assert packing.op3_packing(frame(spark, []).where("false")).count() == 0


def test_added_tokens(spark):
    """The operator's ids are those of the tokenizer as it comes, which knows its added tokens inside a text."""
    end = "<|endoftext|>"
    rows = [(1, f"one {end} two"), (2, end * 3), (3, f"{end} x\n\n{end}'s"), (4, "<|endoftext| > plain"), (5, f"a  {end}  b <{end}>")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in sorted(packing.op3_packing(frame(spark, rows)).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for doc, text in rows:
        ids, at = tokenizer.encode(text, add_special_tokens=False).ids + [1], 0
        assert (50256 in ids) == (end in text)
        for n, found in zip(packing.piece_lengths(len(ids), 2048), got[doc], strict=True):
            assert found == (at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids))
            at += n
