"""Repeated byte strings by suffix arrays over shards.

Strings of ``length`` bytes that repeat anywhere are found exactly, and on the way those of ``least`` bytes. Each string
of ``least`` bytes has an anchor, the 32 bytes in it with the smallest hash, first place first: equal strings have equal
anchors at equal offsets. Consecutive strings of a document with one anchor are a context; its text reaches ``length``
bytes from its last start, as far as the document does.

1. Every chunk sends the anchor's hash and a digest of each of its contexts. A context that occurs
   twice repeats with all its strings. An anchor with one context only needs nothing more.
2. Of anchors with several different contexts, each context is sent once to the shard of its
   anchor. The shard's texts get a suffix array by induced sorting (``induced``) and permuted
   common prefixes; a string repeats if its common prefix with a neighbour is long enough.
3. Each chunk removes what its strings cover and reports.

Equal contexts collapse before texts are sent. An anchor with over ``CROWD`` different contexts, such
as that of a passage within otherwise different documents, would make a shard grow with the
corpus. Its contexts are resolved string by string instead: a 128-bit digest of each string, sent
once per chunk, with the same result.

Defined results: null texts are empty. Rows that repeat a doc_id are documents of their own, so two
equal rows repeat each other. A null doc_id is kept as such. An empty table gives no rows; columns
besides doc_id and text are not looked at. Very long texts are taken whole: a chunk has one document at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.chunks import Chunk, by_range, cuts, join_arrays, make_chunks, over_chunks, ranges
from cinderlake.llm.induced import permuted_lcp, suffix_array

GRAM, CROWD = 32, 1000
#: Contexts and strings that a key range has in the mean, and bytes of text for one shard.
RANGE_KEYS, RANGE_STRINGS, SHARD_BYTES = 500_000, 1_000_000, 2_000_000
#: A byte that UTF-8 never has, between the contexts of a shard.
BETWEEN = b"\xff"
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept_sha256 string, n_repeated long"
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_LOW = np.uint64(0xFFFFFFFF)


def _finish(h):
    h = (h ^ (h >> np.uint64(29))) * _MULTIPLIERS[1]
    return h ^ (h >> np.uint64(32))


def run_hashes(data, size: int, salt: int = 0):
    """64-bit hash of the ``size`` bytes from each place on, put together from runs of 1, 2, 4 ..."""
    built, width = _finish((data.astype(np.uint64) + np.uint64(1 + 1000 * salt)) * _MULTIPLIERS[4]), 1
    have, covered, level = None, 0, 0
    while True:
        if size & width:
            if have is None:
                have, covered = built, width
            else:
                left = len(data) - covered - width + 1
                have, covered = have[:left] * _MULTIPLIERS[3] + built[covered : covered + left], covered + width
        if 2 * width > size:
            return _finish(have)
        left = max(0, len(data) - 2 * width + 1)
        built, width, level = built[:left] * _MULTIPLIERS[level % 3] + built[width : width + left], 2 * width, level + 1


def contexts(chunk: Chunk, length: int, least: int):
    """Anchor hash, first and last start, and end of the text of each context of a chunk."""
    none = np.empty(0, np.uint64), *[np.empty(0, np.int64) for _ in range(3)]
    data, wide = chunk.data, least - GRAM + 1
    strings = len(data) - least + 1
    if strings < 1:
        return none
    h = run_hashes(data, GRAM)
    grams = len(h)
    key = np.full(-(-grams // wide) * wide, np.iinfo(np.uint64).max)
    key[:grams] = (h & ~_LOW) | np.arange(grams, dtype=np.uint64)
    key = key.reshape(-1, wide)
    up = np.minimum.accumulate(key, axis=1).ravel()
    down = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(down[:strings], up[wide - 1 : wide - 1 + strings]) & _LOW).astype(np.int64)
    inside = np.zeros(strings + 1, np.int8)
    whole = chunk.ends - chunk.begins >= least
    np.add.at(inside, chunk.begins[whole], 1)
    np.add.at(inside, chunk.ends[whole] - least + 1, -1)
    inside = np.cumsum(inside[:strings]) > 0
    new = np.ones(strings, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[chunk.begins[whole]] = True
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none
    # a context ends where the next one begins or where its document has no further string
    last = np.flatnonzero(inside & ~np.append(inside[1:], False) | np.append(new[1:], True) & inside)
    end = np.minimum(last + length, chunk.ends[np.searchsorted(chunk.ends, first, "right")])
    # minima of hashes are small: mixed again they spread over all ranges
    return _finish(h[anchor[first]] ^ _MULTIPLIERS[5]), first, last, end


class _Contexts:
    """Contexts of a chunk (``first, last, end``, ``which`` distinct one) and, by range and key, the distinct ones."""

    def __init__(self, chunk: Chunk, length: int, least: int, parts: int):
        h, self.first, self.last, self.end = contexts(chunk, length, least)
        body, blake = chunk.body, hashlib.blake2b
        digest = np.frombuffer(b"".join([blake(body[a:b], digest_size=8).digest() for a, b in zip(self.first.tolist(), self.end.tolist())]), np.uint64)
        r = ranges(h, parts)
        order = np.lexsort((digest, h, r))
        hs, ds = h[order], digest[order]
        new = np.ones(len(order), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.range, self.anchor, self.digest = r[order][new], hs[new], ds[new]
        self.count = np.bincount(self.which, minlength=int(new.sum())) if len(order) else np.empty(0, np.int64)
        self.example = np.zeros(len(self.count), np.int64)
        self.example[self.which[::-1]] = np.arange(len(self.which))[::-1]


def _states(parts: int, r, answers: dict):
    """Per distinct key: 1 repeats, 2 send its text, 4 crowded."""
    out = np.zeros(len(r), np.uint8)
    for n, a, b in cuts(r, parts):
        out[a:b] = np.frombuffer(answers[n], np.uint8)
    return out


def _strings(chunk: Chunk, c: _Contexts, state, parts: int, size: int, salt: int):
    """Strings of ``size`` bytes of crowded contexts: starts, their keys' number, ranges and keys, and which occur twice here."""
    own = np.flatnonzero((state & 6) == 6)
    begin = c.first[c.example[own]]
    number = np.minimum(c.last[c.example[own]], c.end[c.example[own]] - size) - begin + 1
    some = number > 0
    own, begin, number = own[some], begin[some], number[some]
    if not len(own):
        none = np.empty(0, np.int64)
        return none, none, none, np.empty((0, 2), np.uint64), np.empty(0, bool)
    full = np.repeat((state[own] & 1).astype(bool), number)
    # only the bytes of these contexts are hashed, one context after another
    span = number + size - 1
    data = np.concatenate([chunk.data[x : x + n] for x, n in zip(begin.tolist(), span.tolist())])
    within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    place = np.repeat(np.cumsum(span) - span, number) + within
    starts = np.repeat(begin, number) + within
    a, b = run_hashes(data, size, salt)[place], run_hashes(data, size, salt + 1)[place]
    r = ranges(a, parts)
    order = np.lexsort((b, a, r))
    a, b = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.cumsum(new) - 1
    more = (np.bincount(which) > 1) | (np.bincount(which, full[order]) > 0)
    return starts[order], which, r[order][new], np.stack([a[new], b[new]], 1), more


def longest_repeats(texts: list[bytes], strings: list[int], length: int) -> list:
    """For the first strings of each text, how many bytes from there on also start elsewhere among these, ``length`` at most."""
    body = BETWEEN.join(texts) + BETWEEN
    s = np.frombuffer(body, np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    room = (np.repeat(begin + size, size + 1) - np.arange(len(s))).astype(np.int32)
    order = suffix_array(s, 256)
    common, _ = permuted_lcp(s, order, room)
    own = np.zeros(len(s) + 1, np.int8)
    np.add.at(own, begin, 1)
    np.add.at(own, begin + np.array(strings), -1)
    at = np.flatnonzero(np.cumsum(own)[order] > 0)
    found = np.zeros(len(s), np.int32)
    if len(at) > 1:
        # between strings that follow each other in the order, the smallest of the prefixes on the way
        both = np.minimum(np.minimum.reduceat(common[order[: at[-1] + 1]], at[:-1] + 1), length)
        found[order[at[1:]]] = both
        found[order[at[:-1]]] = np.maximum(found[order[at[:-1]]], both)
    return [found[b : b + n] for b, n in zip(begin.tolist(), strings)]


def _runs(found) -> np.ndarray:
    """Begin and end of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]).astype(np.int8))).reshape(-1, 2)


def repeated_bytes(documents: DataFrame, length: int = 400, least: int = 256) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs, and digest of the bytes that stay.

    ``n_repeated`` counts the bytes covered by repeated strings of ``least`` bytes (GRAM at least, ``length`` at most).
    """
    chunks = make_chunks(documents)
    size = chunks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    density = 2 / (least - GRAM + 2)
    parts, shards = max(1, int(size * density / RANGE_KEYS) + 1), max(1, -(-size // SHARD_BYTES))
    crowd_parts, both = max(1, -(-size // (8 * RANGE_STRINGS))), (length, least)

    def send(chunk: Chunk, _: dict) -> Iterator[pd.DataFrame]:
        c = _Contexts(chunk, length, least, parts)
        rows = [(chunk.id, n, c.anchor[a:b].tobytes(), c.digest[a:b].tobytes(), (c.count[a:b] > 1).astype(np.uint8).tobytes()) for n, a, b in cuts(c.range, parts)]
        yield pd.DataFrame(rows, columns=["chunk", "range", "anchors", "digests", "more"])

    def judge(rows: pd.DataFrame) -> list[bytes]:
        h, sizes = join_arrays(rows["anchors"], np.uint64)
        digest, _ = join_arrays(rows["digests"], np.uint64)
        more, _ = join_arrays(rows["more"], np.uint8)
        order = np.lexsort((digest, h))
        hs, ds = h[order], digest[order]
        anew = np.ones(len(order), bool)
        anew[1:] = hs[1:] != hs[:-1]
        new = anew.copy()
        new[1:] |= ds[1:] != ds[:-1]
        group = np.cumsum(new) - 1
        times = np.add.reduceat(1 + more[order].astype(np.int64), np.flatnonzero(new))
        different = np.add.reduceat(new.astype(np.int64), np.flatnonzero(anew))[np.cumsum(anew) - 1]
        state = (times[group] > 1).astype(np.uint8)
        state |= np.where(new & (different > 1), 2, 0).astype(np.uint8)
        state |= np.where(different > CROWD, 4, 0).astype(np.uint8)
        out = np.empty(len(order), np.uint8)
        out[order] = state
        return [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]

    sent = over_chunks(chunks, send, "chunk long, range long, anchors binary, digests binary, more binary")
    states = by_range(sent, judge, "bytes-states")

    def pass_on(chunk: Chunk, answers: dict) -> Iterator[pd.DataFrame]:
        """Range 3 n: texts for shard n; 3 n + 1 and 3 n + 2: keys of crowded strings of either size."""
        c = _Contexts(chunk, length, least, parts)
        state = _states(parts, c.range, answers)
        own = np.flatnonzero((state & 6) == 2)
        rows = []
        for n, a, b in cuts(ranges(c.anchor[own], shards), shards):
            at = c.example[own[a:b]]
            held = [chunk.body[x:y] for x, y in zip(c.first[at].tolist(), c.end[at].tolist())]
            strings, sizes = (c.last[at] - c.first[at] + 1).astype(np.int32), np.array([len(t) for t in held], np.int32)
            rows.append((chunk.id, 3 * n, own[a:b].astype(np.int32).tobytes(), sizes.tobytes(), strings.tobytes(), (state[own[a:b]] & 1).tobytes(), b"".join(held)))
        for k, bytes_of in enumerate(both):
            _, _, r, keys, more = _strings(chunk, c, state, crowd_parts, bytes_of, 2 * k)
            rows += [(chunk.id, 3 * n + 1 + k, b"", b"", b"", more[a:b].astype(np.uint8).tobytes(), keys[a:b].tobytes()) for n, a, b in cuts(r, crowd_parts)]
        yield pd.DataFrame(rows, columns=["chunk", "range", "numbers", "sizes", "strings", "flags", "body"])

    def resolve(rows: pd.DataFrame) -> list[bytes]:
        return sort(rows) if rows["range"].iloc[0] % 3 == 0 else count(rows)

    def sort(rows: pd.DataFrame) -> list[bytes]:
        sizes, counts = join_arrays(rows["sizes"], np.int32)
        strings, _ = join_arrays(rows["strings"], np.int32)
        numbers, _ = join_arrays(rows["numbers"], np.int32)
        full, _ = join_arrays(rows["flags"], np.uint8)
        body = b"".join(rows["body"])
        ends = np.cumsum(sizes.astype(np.int64))
        held = [body[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
        found = longest_repeats(held, strings.tolist(), length)
        out, at = [], 0
        for n in counts.tolist():
            runs = []
            for k in range(at, at + n):
                if not full[k]:
                    for kind, bytes_of in enumerate(both):
                        runs += [(numbers[k], kind, a, b) for a, b in _runs(found[k] >= bytes_of)]
            out.append(np.array(runs, np.int32).tobytes())
            at += n
        return out

    def count(rows: pd.DataFrame) -> list[bytes]:
        keys, sizes = join_arrays(rows["body"], np.uint64)
        more, _ = join_arrays(rows["flags"], np.uint8)
        keys, sizes = keys.reshape(-1, 2), sizes // 2
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        ks = keys[order]
        new = np.ones(len(order), bool)
        new[1:] = (ks[1:] != ks[:-1]).any(1)
        times = np.add.reduceat(1 + more[order].astype(np.int64), np.flatnonzero(new))
        out = np.empty(len(order), bool)
        out[order] = (times > 1)[np.cumsum(new) - 1]
        return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]

    sent = over_chunks(chunks, pass_on, "chunk long, range long, numbers binary, sizes binary, strings binary, flags binary, body binary", states)
    resolved = by_range(sent, resolve, "bytes-resolved")

    def finish(chunk: Chunk, answers: dict) -> Iterator[pd.DataFrame]:
        c = _Contexts(chunk, length, least, parts)
        state = _states(parts, c.range, {-1 - k: v for k, v in answers.items() if k < 0})
        full = (state[c.which] & 1).astype(bool)
        sorted_runs = [np.frombuffer(v, np.int32).reshape(-1, 4).astype(np.int64) for k, v in answers.items() if k >= 0 and k % 3 == 0 and len(v)]
        covered = []
        for kind, bytes_of in enumerate(both):
            step = np.zeros(len(chunk.data) + 1, np.int64)
            begin, past = c.first[full], np.minimum(c.last[full] + bytes_of, c.end[full])
            some = past - begin >= bytes_of
            np.add.at(step, begin[some], 1)
            np.add.at(step, past[some], -1)
            for runs in sorted_runs:
                runs = runs[runs[:, 1] == kind]
                begin = c.first[c.example[runs[:, 0]]]
                np.add.at(step, begin + runs[:, 2], 1)
                np.add.at(step, begin + runs[:, 3] - 1 + bytes_of, -1)
            starts, number, r, _, _ = _strings(chunk, c, state, crowd_parts, bytes_of, 2 * kind)
            good = np.zeros(len(r), bool)
            for n, a, b in cuts(r, crowd_parts):
                good[a:b] = np.unpackbits(np.frombuffer(answers[3 * n + 1 + kind], np.uint8), count=b - a).astype(bool)
            if len(starts):
                np.add.at(step, starts[good[number]], 1)
                np.add.at(step, starts[good[number]] + bytes_of, -1)
            covered.append(np.cumsum(step)[: len(chunk.data)] > 0)
        gone, repeated = covered
        out = []
        for doc, a, b in chunk.texts():
            own, text, spans = gone[a:b], chunk.body[a:b], []
            if own.any():
                spans = [{"start": int(x), "length": int(y - x)} for x, y in _runs(own)]
                text = chunk.data[a:b][~own].tobytes()
            out.append((doc, b - a, int(own.sum()), spans, hashlib.sha256(text).hexdigest(), int(repeated[a:b].sum())))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "n_repeated"])
        frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64")
        yield frame

    answers = states.select("chunk", (-1 - F.col("range")).alias("range"), "answer").unionByName(resolved.select("chunk", "range", "answer"))
    return over_chunks(chunks, finish, RESULT, answers)


def op1_suffix_dedup(documents: DataFrame) -> DataFrame:
    """The contract's columns, and the bytes covered by repeated strings of 256 bytes."""
    out = repeated_bytes(documents)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_repeated")
