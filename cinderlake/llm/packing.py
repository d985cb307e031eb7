"""Packing by power-of-two decomposition.

The tokens of a document are cut into pieces whose lengths are powers of two: as many of the
maximum as fit, then the binary digits of the rest, largest first. A piece is a whole sequence, so
no sequence crosses documents and none is padded; sequences of equal length form a bucket, from
which batches are drawn. A map-only job: nothing is shuffled.

Defined results: a null or empty text has only the closing id, one piece of length 1. Rows that
repeat a doc_id are packed each for itself. Added tokens of the tokenizer are cut out of a text first and
have their own ids; without any (a rank file has none) their strings are ordinary text. A null doc_id stays null. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Cached words of a Python worker, and the characters from which a word isn't cached.
CACHE_WORDS, CACHE_CHARS = 400_000, 40


class WordTokens(dict):
    """Token ids of a pre-token as little-endian 32-bit bytes, computed when first met."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = public_tokenizers.PATTERN

    def __missing__(self, word: str) -> bytes:
        import numpy as np

        out = np.array(self.encoding.encode_ordinary(word), "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


def token_bytes(text: str, words: WordTokens, pattern) -> bytes:
    """All ids of a text; a long text goes through in slices of words."""
    if len(text) < 1_000_000:
        return b"".join(map(words.__getitem__, pattern.findall(text)))
    found, parts = (m.group() for m in pattern.finditer(text)), []
    while part := list(islice(found, 100_000)):
        parts.append(b"".join(map(words.__getitem__, part)))
    return b"".join(parts)


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer's JSON, which it recognises inside a text, with their ids."""
    import json

    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    if any(t[k] for t in found for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take blanks or word bounds into account aren't covered")
    return {t["content"]: t["id"] for t in found}


def split_bytes(text: str, words: WordTokens, pattern, added: dict[str, int], cut) -> bytes:
    """All ids of a text whose added tokens, found by ``cut``, have their own."""
    if not any(a in text for a in added):
        return token_bytes(text, words, pattern)
    return b"".join([added[t].to_bytes(4, "little") if t in added else token_bytes(t, words, pattern) for t in cut.split(text)])


def piece_lengths(tokens: int, longest: int) -> list[int]:
    """Powers of two that add up to ``tokens``, none over ``longest`` (itself a power of two)."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(documents: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece with its place in its document, checksum and, if asked for, its ids."""
    own = added or {}
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        import regex

        words = WordTokens(tokenizer)
        pattern, end = regex.compile(words.pattern), int(end_id).to_bytes(4, "little")
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(own, key=len, reverse=True))) + ")")
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = split_bytes(text or "", words, pattern, own, cut) + end
                n, at = len(data) // 4, 0
                for size in piece_lengths(n, longest):
                    part = data[4 * at : 4 * (at + size)]
                    row = (doc, at, size, zlib.crc32(part), n)
                    out.append(row + (np.frombuffer(part, "<u4").astype("int32").tolist(),) if with_ids else row)
                    at += size
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64")
            yield frame

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def pack(documents: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``length`` is the bucket of a sequence.

    The ids number the rows within partitions of the scan and are unique; they don't follow one
    another without gaps, because that would need a pass for counting first.
    """
    return pieces(documents, tokenizer, longest, end_id, with_ids, added).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def buckets(packed: DataFrame) -> DataFrame:
    """Sequences and tokens per bucket of equal lengths: what a batch sampler needs to know."""
    return packed.groupBy("length").agg(F.count(F.lit(1)).alias("sequences"), F.sum("length").alias("tokens"))


def op3_packing(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The contract's columns."""
    import public_tokenizers

    if tokenizer is None:
        tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack(documents, tokenizer, added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
