"""Benchmark decontamination by SimHash of item-sized windows.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; shingles have five words, repeats count
(fewer words: the whole sequence). A window has as many words as the items it is compared with (the
whole document if that is shorter).

1. The shingles of all items of one length are one set. A window that reaches the similarity with any item of
   that length has at least ``needed`` of its shingles in this set; windows with fewer are passed over.
   The set says nothing about which item a window is like.
2. The others get their SimHash from rolling sums and look it up in the tables of their length. Fingerprints
   have ``SEGMENTS`` segments; each item is entered under all points of the Hamming ball of radius ``BALL``
   around each of its segments. Fingerprints within ``RADIUS`` = 20 bits agree in one of seven segments up to two
   bits, so all items within RADIUS are found, and only candidates with that complete distance go on.
3. Candidates are verified by the weighted-shingle similarity, sum of minima over sum of maxima of the
   shingles' counts, and count from ``SIMILARITY`` on.

At a similarity of 0.8 fingerprints differ by 10 bits in the mean with a deviation of 3. RADIUS is three
deviations more; the tests measure what it loses.

Items are the query set, taken in parts of ``ITEM_WORDS`` words. A part's items are sent to the tasks, and all documents
are matched with it, so neither the driver nor a task holds more than a few parts. With several parts what is found is written per
``PARTS_AT_ONCE`` of them: digests of texts and their leaks, no texts; the documents find theirs by digest in the end.

Defined results: null and blank texts and items match nothing. Rows that repeat a doc_id are judged each for
itself; so are repeated items, and an item_id with several texts is one item with all of them. An item_id may have any type that has an
order; items without one are left out. Ties go to the
smallest item_id. Empty tables give no rows, or no match. Very long texts are taken whole: the sums run over the
covered stretches only. Columns besides doc_id and text, item_id and text are not looked at, and none is replaced.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import bounded, free_name
from cinderlake.session import written

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
SEGMENTS, BALL = 7, 2
RADIUS = SEGMENTS * (BALL + 1) - 1
ITEM_WORDS, PARTS_AT_ONCE = 200_000, 4


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list) -> list[tuple]:
    """Runs of SHINGLE words; fewer words are one run."""
    if len(words) <= SHINGLE:
        return [tuple(words)] if words else []
    return list(zip(*[words[k:] for k in range(SHINGLE)]))


def similarity(a: Counter, b: Counter) -> float:
    """Sum of minima over sum of maxima."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / max(1, a.total() + b.total() - both)


def needed(window: int, size: int) -> int:
    """Shingles that a window of ``window`` shares with an item of ``size`` at least, if they have SIMILARITY."""
    return max(1, math.ceil(SIMILARITY * (window + size) / (1 + SIMILARITY) - 1e-9))


def fingerprints(runs: list[tuple], starts, size: int, cache: dict):
    """Fingerprints of the windows of ``size`` shingles that begin at ``starts``, from one rolling sum."""
    import numpy as np
    import xxhash

    lo, hi = int(starts[0]), min(int(starts[-1]) + size, len(runs))
    for s in runs[lo:hi]:
        if s not in cache:
            cache[s] = xxhash.xxh64_digest(b" ".join(s), SEED)
    digests = np.frombuffer(b"".join([cache[s] for s in runs[lo:hi]]), np.uint8).reshape(-1, 8)
    ones = np.zeros((hi - lo + 1, 64), np.int32)
    np.cumsum(np.unpackbits(digests, axis=1), axis=0, out=ones[1:])
    a = np.asarray(starts) - lo
    b = np.minimum(a + size, hi - lo)
    return np.packbits(2 * (ones[b] - ones[a]) > (b - a)[:, None], axis=1).view(">u8").astype(np.uint64)[:, 0]


def segments(prints) -> list:
    """The values of each segment of 64-bit fingerprints, and the segment's width."""
    import numpy as np

    edges = [64 * k // SEGMENTS for k in range(SEGMENTS + 1)]
    return [((prints >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)).astype(np.int64), b - a) for a, b in zip(edges, edges[1:])]


class Tables:
    """Multi-index of the fingerprints of items of one length: per segment a table from point to items."""

    def __init__(self, prints):
        import numpy as np

        self.prints, self.tables = prints, []
        for values, width in segments(prints):
            ball = [sum(1 << p for p in points) for n in range(BALL + 1) for points in combinations(range(width), n)]
            points = (values[:, None] ^ np.array(ball, np.int64)).ravel()
            owner = np.repeat(np.arange(len(values)), len(ball))
            order = np.argsort(points, kind="stable")
            first = np.searchsorted(points[order], np.arange((1 << width) + 1))
            self.tables.append((first, owner[order]))

    def within(self, prints) -> list[tuple[int, int]]:
        """Pairs (row of ``prints``, item) of a complete distance of RADIUS at most."""
        import numpy as np

        rows, items = [], []
        for (values, _), (first, owner) in zip(segments(prints), self.tables):
            begin, n = first[values], first[values + 1] - first[values]
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            rows.append(np.repeat(np.arange(len(values)), n))
            items.append(owner[at])
        row, item = np.concatenate(rows), np.concatenate(items)
        near = np.bitwise_count(prints[row] ^ self.prints[item]) <= RADIUS
        return sorted(set(zip(row[near].tolist(), item[near].tolist())))


class Items:
    """One part of the items: by number of shingles, their set of shingles and their tables."""

    def __init__(self, rows: list[tuple]):
        import numpy as np

        self.ids: list = []
        self.counts: list[Counter] = []
        by_size: dict = defaultdict(list)
        self.sizes: dict = defaultdict(set)
        prints = []
        for item, text in sorted(rows):
            runs = shingles(words_of(text))
            if not runs:
                continue
            by_size[len(runs), len(runs[0])].append(len(self.ids))
            self.ids.append(item)
            self.counts.append(Counter(runs))
            for s in runs:
                self.sizes[s].add(len(runs))
            prints.append(fingerprints(runs, [0], len(runs), {})[0])
        all_prints = np.array(prints, np.uint64)
        grouped: dict = defaultdict(list)
        for (size, _), own in by_size.items():
            grouped[size] += own
        self.by_size = {size: (own, Tables(all_prints[own])) for size, own in grouped.items()}
        self.vocabulary = {w for s in self.sizes for w in s}

    def matches(self, text: str | None) -> dict:
        """Best similarity by item of one text."""
        words = words_of(text)
        if not words or self.vocabulary.isdisjoint(words):
            return {}
        runs, places = shingles(words), defaultdict(list)
        get = self.sizes.get
        for p, found in [(p, x) for p, x in enumerate(map(get, runs)) if x]:
            for size in found:
                places[size].append(p)
        best: dict = {}
        cache: dict = {}
        for size, held in places.items():
            own, tables = self.by_size[size]
            for starts in self.stretches(self.full_starts(held, size, len(runs)), size):
                for row, k in tables.within(fingerprints(runs, starts, size, cache)):
                    s = starts[row]
                    item = own[k]
                    sim = similarity(Counter(runs[s : s + size]), self.counts[item])
                    if sim >= SIMILARITY and sim > best.get(self.ids[item], 0):
                        best[self.ids[item]] = sim
        return best

    @staticmethod
    def full_starts(places: list[int], size: int, total: int) -> list[int]:
        """Starts of windows of ``size`` that hold enough of ``places``, in a text of ``total`` shingles."""
        import numpy as np

        window = min(size, total)
        need = needed(window, size)
        if len(places) < need:
            return []
        held = np.zeros(total + 1, np.int64)
        held[np.array(places) + 1] = 1
        held = np.cumsum(held)
        return np.flatnonzero(held[window:] - held[: total + 1 - window] >= need).tolist()

    @staticmethod
    def stretches(starts: list[int], size: int, most: int = 20_000) -> list[list[int]]:
        """Starts in groups of ``most`` whose windows touch, so that sums run over covered parts only."""
        out: list[list[int]] = []
        for s in starts:
            if not out or s - out[-1][-1] > size or len(out[-1]) == most:
                out.append([])
            out[-1].append(s)
        return out


def item_parts(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items in parts of ITEM_WORDS words at most (one item at least), one part after another."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    part: list = []
    size = 0
    for r in items.where("item_id is not null and text is not null").toLocalIterator():
        n = len(words_of(r["text"]))
        if part and size + n > ITEM_WORDS:
            yield part
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += n
    if part:
        yield part


def leaks_type(benchmark: DataFrame) -> str:
    """Type of what is found in a document: items and their best similarity."""
    return f"array<struct<item_id:{benchmark.schema['item_id'].dataType.simpleString()},similarity:double>>"


def match_column(part: list[tuple], text: Column, kind: str) -> Column:
    """Leaks of the items of one part."""
    kept: list = []

    def match(texts: pd.Series) -> pd.Series:
        if not kept:
            kept.append(Items(part))
        return pd.Series([[{"item_id": i, "similarity": float(s)} for i, s in sorted(kept[0].matches(t).items())] for t in texts])

    return F.pandas_udf(match, kind)(text)


def _merged(leaks: Column) -> Column:
    """Each item once, with its best similarity."""
    ids = F.array_distinct(F.transform(leaks, lambda x: x["item_id"]))
    best = lambda i: F.array_max(F.transform(F.filter(leaks, lambda x: x["item_id"] == i), lambda x: x["similarity"]))
    return F.transform(ids, lambda i: F.struct(i.alias("item_id"), best(i).alias("similarity")))


def contamination(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, str]:
    """``documents`` with one more column, and its name: array of item_id and best similarity of any window.

    The name is ``leaks``, with underscores appended while ``documents`` has such a column.
    """
    name, kind = free_name(documents, "leaks"), leaks_type(benchmark)
    texts, groups, held = documents.select(F.col("text").cast("string").alias("text")), [], []

    def close() -> None:
        found = texts.select(F.sha2("text", 256).alias("digest"), F.concat(*held).alias("leaks")).where(F.size("leaks") > 0)
        groups.append(written(found.groupBy("digest").agg(F.first("leaks").alias("leaks")), "leaks"))
        held.clear()

    for part in item_parts(benchmark):
        if len(held) == PARTS_AT_ONCE:
            close()
        held.append(match_column(part, F.col("text").cast("string"), kind))
    if not groups and len(held) < 2:
        return documents.withColumn(name, held[0] if held else F.array().cast(kind)), name
    close()
    every = groups[0]
    for one in groups[1:]:
        every = every.unionByName(one)
    digest, leaks = free_name(documents, "_digest"), free_name(documents, "_leaks")
    every = every.groupBy("digest").agg(F.flatten(F.collect_list("leaks")).alias("leaks"))
    every = written(every.select(F.col("digest").alias(digest), _merged(F.col("leaks")).alias(leaks)), "leaks")
    out = documents.join(bounded(every), F.sha2(F.col("text").cast("string"), 256) == F.col(digest), "left").drop(digest)
    return out.withColumn(name, F.coalesce(F.col(leaks), F.array().cast(kind))).drop(leaks), name


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that no item was found in, all columns as they are."""
    found, name = contamination(documents, benchmark)
    return found.where(F.size(F.col(name)) == 0).select(*[F.col(f"`{c}`") for c in documents.columns])


def op10_decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: contaminated, n_items, the best item and its similarity, and all items found."""
    out, _ = contamination(documents.select("doc_id", "text"), benchmark)
    best = F.array_min(F.transform("leaks", lambda x: F.struct((-x["similarity"]).alias("s"), x["item_id"].alias("i"))))
    return out.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").alias("n_items"), best["i"].alias("best_item"),
        (-best["s"]).alias("similarity"), F.array_join(F.transform(F.array_sort(F.transform("leaks", lambda x: x["item_id"])), lambda i: i.cast("string")), ",").alias("items"),
    )
