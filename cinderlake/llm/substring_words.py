"""Repeated runs of words by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window (10 of 20 words). A
window of 20 words has a whole block of any document that it occurs in, so what repeats
elsewhere is found by probing the blocks with every rolling window of 10 words: that is the first
exchange. A probe hits if its key is that of a block and occurs more than once. Hits are then
extended: each window of 20 words around a hit is looked up by its complete key in the second
exchange, where the smallest doc_id with that key is found; neighbouring windows join to maximal
repeats. A word's key is made of two polynomials of its bytes modulo a prime (62 bits), so words of no shape are taken for
each other; a window's key of 64 bits besides its range is made of its words' keys. The words themselves aren't sent.

Both exchanges send each distinct key of a chunk once, however often it occurs, so a passage that
a third of the documents share costs a range one entry per chunk. Nothing is linked pairwise.

Defined results: null, empty and blank texts have no words. Texts and words of any length are taken whole. Rows that repeat a doc_id don't count as
earlier than each other. A null doc_id is smaller than any other. An empty table gives no rows;
columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.chunks import Chunk, by_range, cuts, join_arrays, make_chunks, over_chunks, ranges

#: Probes that a key range has in the mean.
RANGE_KEYS = 2_000_000
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept_sha256 string"
#: Modulus and bases of the words' polynomials, and a value for each byte.
_PRIME, _BASES, _BLOCK = np.uint64((1 << 31) - 1), (1_245_678_911, 741_903_457), 1 << 20
_VALUES = np.random.default_rng(17).integers(1, (1 << 31) - 1, 256).astype(np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9))


def _mixed(x):
    x = (x ^ (x >> np.uint64(31))) * _C
    return x ^ (x >> np.uint64(29))


@lru_cache(len(_BASES) * 2)
def _powers(base: int):
    """Powers modulo the prime of a base, _BLOCK of them."""
    few = 1 << 10
    small, large = np.ones(few, np.uint64), np.ones(_BLOCK // few, np.uint64)
    for table, factor in ((small, base), (large, pow(base, few, int(_PRIME)))):
        for k in range(1, len(table)):
            table[k] = int(table[k - 1]) * factor % int(_PRIME)
    return (large[:, None] * small[None, :] % _PRIME).ravel()


def _reduced(x):
    """Numbers below 2 ** 62 modulo the prime, up to a multiple of it that leaves them below 2 ** 32."""
    return (x & _PRIME) + (x >> np.uint64(31))


def _polynomials(data, first, last, base: int):
    """Each word's polynomial modulo a prime: the sum of its bytes' values times powers of ``base`` by their place in the word.

    Different words of n letters agree for n of 2 ** 31 bases at most, whatever their shape. Sums run over the whole chunk with powers that start anew
    every _BLOCK bytes, and are made independent of the place by the inverse power; words over the edge of a block are added up by themselves.
    """
    power, back = _powers(base), _powers(pow(base, -1, int(_PRIME)))
    value, total = _VALUES[data], np.zeros(len(data) + 1, np.uint64)
    for at in range(0, len(data), _BLOCK):
        part = value[at : at + _BLOCK]
        part *= power[: len(part)]
    np.cumsum(_reduced(value), out=total[1:])
    out = (total[last + 1] - total[first]) % _PRIME * back[first % _BLOCK] % _PRIME
    for k in np.flatnonzero(first // _BLOCK != last // _BLOCK).tolist():
        word, whole = _VALUES[data[first[k] : last[k] + 1]], 0
        for at in range(0, len(word), _BLOCK):
            part = word[at : at + _BLOCK]
            whole += int(_reduced(part * power[: len(part)]).sum()) * pow(base, at, int(_PRIME))
        out[k] = whole % int(_PRIME)
    return out


class Words:
    """Words of a chunk, none across documents: key of each, and of runs of them."""

    def __init__(self, chunk: Chunk):
        data = chunk.data
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        first = np.ones(len(data), bool)
        first[1:] = blank[:-1]
        first[chunk.begins[chunk.begins < len(data)]] = True
        last = np.ones(len(data), bool)
        last[:-1] = blank[1:]
        last[chunk.ends[chunk.ends > 0] - 1] = True
        self.first, self.last = np.flatnonzero(first & ~blank), np.flatnonzero(last & ~blank)
        self.doc = np.searchsorted(chunk.ends, self.first, "right")
        self.begins = np.searchsorted(self.doc, np.arange(len(chunk.ids)))
        self.ends = np.searchsorted(self.doc, np.arange(len(chunk.ids)), "right")
        one, two = (_polynomials(data, self.first, self.last, base) for base in _BASES)
        both = one << np.uint64(31) | two
        self.key, self.second = _mixed(both + _A), _mixed(_mixed(both + _B) + one)

    def runs(self, size: int, base: np.uint64, second: bool = False):
        """Key of the run of ``size`` words that begins at each word, and whether it stays in its document.

        ``second`` builds it from the other halves of the words' digests, so two keys of a run are independent.
        """
        keys = self.second if second else self.key
        n = len(keys)
        if n < size:
            return np.empty(0, np.uint64), np.empty(0, bool)
        # runs of 1, 2, 4 ... words are put together by the binary digits of size
        have, width, built, length = None, 0, keys, 1
        while True:
            if size & length:
                if have is None:
                    have, width = built, length
                else:
                    left = n - width - length + 1
                    have, width = have[:left] * base ** np.uint64(length) + built[width : width + left], width + length
            if 2 * length > size:
                break
            left = n - 2 * length + 1
            built, length = built[:left] * base ** np.uint64(length) + built[length : length + left], 2 * length
        at = np.arange(n - size + 1)
        return _mixed(have), self.doc[at] == self.doc[at + size - 1]


def _probes(words: Words, block: int, parts: int):
    """Distinct probes in the order of range and key; for each place its probe or -1, and flags."""
    key, inside = words.runs(block, _B)
    place = np.flatnonzero(inside)
    key = key[place]
    packed = (ranges(key, parts).astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
    distinct, which, count = np.unique(packed, return_inverse=True, return_counts=True)
    aligned = (place - words.begins[words.doc[place]]) % block == 0
    flags = (count > 1).astype(np.uint8)
    flags[which[aligned]] |= 2
    return place, which, distinct, flags


def _windows(words: Words, block: int, window: int, parts: int, answers: dict):
    """Windows around hits: places, index of their distinct keys, the keys' ranges and 64 bits."""
    place, which, distinct, _ = _probes(words, block, parts)
    hit = np.zeros(len(distinct), bool)
    for r, a, b in cuts((distinct >> np.uint64(32)).astype(np.int64), parts):
        hit[a:b] = np.unpackbits(np.frombuffer(answers[r], np.uint8), count=b - a).astype(bool)
    hits = np.zeros(len(words.key) + 1, np.int64)
    hits[place[hit[which]] + 1] = 1
    hits = np.cumsum(hits)
    key, inside = words.runs(window, _A)
    at = np.flatnonzero(inside)
    at = at[hits[at + window - block + 1] > hits[at]]
    other, _ = words.runs(window, _C, second=True)
    key, other = key[at], other[at]
    order = np.lexsort((other, ranges(key, parts)))
    r, k = ranges(key, parts)[order], other[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return at[order], np.cumsum(new) - 1, r[new], k[new]


def _doc_order(chunk: Chunk):
    """Ids for comparing; null is smallest."""
    return np.array([np.iinfo(np.int64).min if i is None else i for i in chunk.ids], np.int64)


def repeated_words(documents: DataFrame, window: int = 20) -> DataFrame:
    """Per document: words, removed words, maximal removed runs, and digest of the words that stay."""
    block = window // 2
    chunks = make_chunks(documents)
    total = chunks.agg(F.sum("words")).first()[0] or 0
    parts = max(1, -(-total // RANGE_KEYS))

    def probe(chunk: Chunk, _: dict) -> Iterator[pd.DataFrame]:
        _, _, distinct, flags = _probes(Words(chunk), block, parts)
        rows = [(chunk.id, r, distinct[a:b].astype(np.uint32).tobytes(), flags[a:b].tobytes()) for r, a, b in cuts((distinct >> np.uint64(32)).astype(np.int64), parts)]
        yield pd.DataFrame(rows, columns=["chunk", "range", "keys", "flags"])

    def hit(rows: pd.DataFrame) -> list[bytes]:
        keys, sizes = join_arrays(rows["keys"], np.uint32)
        flags, _ = join_arrays(rows["flags"], np.uint8)
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        times = np.add.reduceat(1 + (flags[order] & 1).astype(np.int64), begin)
        blocks = np.bitwise_or.reduceat(flags[order], begin) & 2
        good = np.empty(len(keys), bool)
        good[order] = ((times > 1) & (blocks > 0))[group]
        return [np.packbits(x).tobytes() for x in np.split(good, np.cumsum(sizes)[:-1])]

    sent = over_chunks(chunks, probe, "chunk long, range long, keys binary, flags binary")
    hits = by_range(sent, hit, "words-hits")

    def look_up(chunk: Chunk, answers: dict) -> Iterator[pd.DataFrame]:
        words = Words(chunk)
        place, which, r, keys = _windows(words, block, window, parts, answers)
        ids = _doc_order(chunk)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[words.doc[place]])
        base = int(least.min()) if len(least) else 0
        wide = len(least) and int(least.max()) - base >= 1 << 32
        rows = [(chunk.id, n, keys[a:b].tobytes(), base, (least[a:b] if wide else (least[a:b] - base).astype(np.uint32)).tobytes(), bool(wide)) for n, a, b in cuts(r, parts)]
        yield pd.DataFrame(rows, columns=["chunk", "range", "keys", "base", "docs", "wide"])

    def earlier(rows: pd.DataFrame) -> list[bytes]:
        keys, sizes = join_arrays(rows["keys"], np.uint64)
        docs = np.concatenate([np.frombuffer(d, np.int64) if w else np.frombuffer(d, np.uint32).astype(np.int64) + b for d, b, w in zip(rows["docs"], rows["base"], rows["wide"], strict=True)])
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        least = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        later = np.empty(len(keys), bool)
        later[order] = docs[order] > least
        return [np.packbits(x).tobytes() for x in np.split(later, np.cumsum(sizes)[:-1])]

    sent = over_chunks(chunks, look_up, "chunk long, range long, keys binary, base long, docs binary, wide boolean", hits)
    firsts = by_range(sent, earlier, "words-firsts")
    both = hits.select("chunk", F.col("range"), "answer").unionByName(firsts.select("chunk", (-1 - F.col("range")).alias("range"), "answer"))

    def finish(chunk: Chunk, answers: dict) -> Iterator[pd.DataFrame]:
        words = Words(chunk)
        place, which, r, keys = _windows(words, block, window, parts, {k: v for k, v in answers.items() if k >= 0})
        later = np.zeros(len(keys), bool)
        for n, a, b in cuts(r, parts):
            later[a:b] = np.unpackbits(np.frombuffer(answers[-1 - n], np.uint8), count=b - a).astype(bool)
        marked = later[which] if len(which) else np.zeros(0, bool)
        if len(which):
            ids, doc = _doc_order(chunk), words.doc[place]
            order = np.lexsort((place, which))
            w, d = which[order], doc[order]
            same = np.zeros(len(order), bool)
            same[1:] = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
            least = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(least, which, ids[doc])
            more = same | (ids[d] > least[w])
            marked = marked.copy()
            marked[order] |= more
        step = np.zeros(len(words.key) + window + 1, np.int64)
        np.add.at(step, place[marked], 1)
        np.add.at(step, place[marked] + window, -1)
        gone = np.cumsum(step)[: len(words.key)] > 0
        out = []
        for (doc, a, b), f, t in zip(chunk.texts(), words.begins.tolist(), words.ends.tolist(), strict=True):
            own, text, spans = gone[f:t], chunk.body[a:b].split(), []
            if own.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                spans = [{"start": int(x), "length": int(y - x)} for x, y in edge.reshape(-1, 2)]
                text = compress(text, (~own).tolist())
            out.append((doc, t - f, int(own.sum()), spans, hashlib.sha256(b" ".join(text)).hexdigest()))
        frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "spans", "kept_sha256"])
        frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64")
        yield frame

    return over_chunks(chunks, finish, RESULT, both)


def op7_substring(documents: DataFrame) -> DataFrame:
    """The contract's columns and the number of removed runs."""
    out = repeated_words(documents)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, unnest(list_transform(range(1, len(w) - 18), lambda s: array_to_string(w[s:s + 19], ' '))) AS k FROM d WHERE len(w) >= 20),
m AS (SELECT doc_id, s FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM m),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d),
j AS (SELECT p.doc_id, p.p, t, r.p IS NOT NULL AS gone, lag(r.p) OVER (PARTITION BY p.doc_id ORDER BY p.p) IS NULL AS first FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.p = p.p),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(t, ' ' ORDER BY p) FILTER (NOT gone) AS kept, count(*) FILTER (gone AND first) AS n_spans FROM j GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN a USING (doc_id)
"""
