"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two halves. Two fingerprints within ``RADIUS`` = 4 bits agree in
one half up to 2 bits. Every fingerprint is entered in a table per half under all points of the
Hamming ball of radius 1 around that half (33 points of 32 bits): halves within 2 bits share a
point. Whatever meets at a point is verified on the complete distance. Only links that join
different components of a point's set are passed on, at most one per member; the components of
the whole follow from connected components over those links.

Distinct fingerprints only are entered, so copies cost nothing. A point with more than
``MOST_AT_POINT`` fingerprints isn't worked off in one task: its members go another, exact way, by
the points of the ball of radius 2 around the complete fingerprint. Two fingerprints share such a
point exactly if they are within 4 bits, so linking each to the smallest at the point needs no
comparison.

``keep_one``, the pipeline's stage, links documents whose sets of five-word shingles have a Jaccard similarity of
``SIMILAR``. Such sets differ in 39 of 256 bits in the mean with a deviation of 6, so it takes ``PRINTS`` = 4 fingerprints, from
independent mixes of the shingle hashes, each in three segments of 21 bits. Of such a pair one segment of twelve is within two
bits, and all bits together are within ``MOST_BITS``, with a probability of 0.99 by the binomial distribution; the tests measure it. These
components are candidates: in there links are verified on complete sets. With segments of 21 bits candidates per document
grow with the corpus, up to about a terabyte of text at bearable cost; the halves of the radius 4 carry on to 100 TB.
Crowded points of such fingerprints are worked off in pairs of blocks.

Defined results: null and empty texts, and texts of blanks, have the fingerprint zero, and link like
any other. Texts with fewer words than a shingle are one shingle. Rows that repeat a doc_id
each get a row. A null doc_id takes part; a component of nulls only has the id null. An empty table
gives no rows; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.chunks import Chunk, by_range, cuts, join_arrays, make_chunks, over_chunks, ranges
from cinderlake.llm.common import bounded, without
from cinderlake.llm.substring_words import Words
from cinderlake.operators.graph import connected_components
from cinderlake.session import written

RADIUS, MOST_AT_POINT = 4, 4096
#: Members of a point that are compared each with each across points; rows taken together.
EACH_WITH_EACH, AT_ONCE = 512, 100_000
SEED = 42
#: Near copies: Jaccard similarity; shingles of a block of sets that are compared; keys that a range has in the mean.
SIMILAR, BLOCK_SHINGLES, RANGE_KEYS = 0.8, 1_000_000, 2_000_000
#: Fingerprints for near copies, the radius that gives each three segments, and bits in which all together may differ.
PRINTS, WIDE, MOST_BITS = 4, 8, 56
RUN_BASE = 0x9E3779B97F4A7C15


def _bits():
    import numpy as np

    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_digests(data: bytes, size: int) -> bytes:
    """XXH64 of every ``size``-word shingle, eight bytes each, big end first; data is lower-cased."""
    import numpy as np
    import xxhash

    words = data.split()
    if not words:
        return b""
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_digest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_digest
    return b"".join([digest(line[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)])


def digest_prints(data: bytes, bits, prints: int = 1) -> list[int]:
    """Signed 64-bit fingerprints of shingle digests: a bit is 1 if set in over half of them.

    Fingerprints after the first take the hashes mixed with other constants.
    """
    import numpy as np

    n = len(data) // 8
    if not n:
        return [0] * prints
    hashes, out = np.frombuffer(data, ">u8"), []
    for k in range(prints):
        if k:
            hashes = (hashes.astype(np.uint64) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            hashes = ((hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).astype(">u8")
        columns = hashes.view(np.uint8).reshape(n, 8)
        ones = np.concatenate([np.bincount(columns[:, c], minlength=256) @ bits for c in range(8)])
        out.append(int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True))
    return out


def fingerprint(text: str | None, size: int, bits, prints: int = 1) -> list[int]:
    """Fingerprints of a text's shingles, repeats included."""
    return digest_prints(shingle_digests((text or "").encode("utf-8", "surrogatepass").lower(), size), bits, prints)


def fingerprints(documents: DataFrame, size: int = 4, prints: int = 1) -> DataFrame:
    """``doc_id, fp`` for each row, and ``fp1`` ... if there are more; whole texts, in Arrow batches."""
    names = ["fp", *[f"fp{k}" for k in range(1, prints)]]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        bits = _bits()
        for batch in batches:
            found = [fingerprint(t, size, bits, prints) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"]} | {n: [f[k] for f in found] for k, n in enumerate(names)})

    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInPandas(run, "doc_id string, " + ", ".join(f"{n} long" for n in names))
    return out.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


def _roots(values, most: int):
    """For rows of uint64: the first row reachable by links of at most ``most`` differing bits."""
    import numpy as np

    n = len(values)
    label, todo = np.arange(n), np.ones(n, bool)
    for first in range(n):
        if not todo[first]:
            continue
        reach = np.array([first])
        todo[first] = False
        while len(reach):
            rest = np.flatnonzero(todo)
            near = np.zeros(len(rest), bool)
            for v in values[reach]:
                near |= np.bitwise_count(values[rest] ^ v).sum(1, dtype=np.int64) <= most
            reach = rest[near]
            todo[reach] = False
            label[reach] = first
    return label


def _meet(names: list[str], most: int, cap: int | None):
    """Work on rows sorted by point: links within each point's set, or its rows marked as crowded."""

    def meet(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        def frame(src, dst, point, crowded):
            out = {"src": src[:, 0].view(np.int64), "dst": dst[:, 0].view(np.int64), "point": point, "crowded": crowded}
            return pd.DataFrame(out | {n: src[:, k].copy().view(np.int64) for k, n in enumerate(names)})

        def link(points, values):
            """Members of all sets are compared at distance 1, 2, 3 ... at once; only sets with many links,
            or very large ones, are worked off by themselves."""
            edge = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1], [True]]))
            size = np.diff(edge)
            group = np.repeat(np.arange(len(size)), size)
            alone = size > EACH_WITH_EACH
            at = np.flatnonzero(~alone[group])
            end, step, src, dst = edge[1:][group], 1, [], []
            while len(at := at[at + step < end[at]]):
                near = at[np.bitwise_count(values[at] ^ values[at + step]).sum(1, dtype=np.int64) <= most]
                src.append(near)
                dst.append(near + step)
                step += 1
            src, dst = np.concatenate([np.empty(0, np.int64), *src]), np.concatenate([np.empty(0, np.int64), *dst])
            alone |= np.bincount(group[src], minlength=len(size)) > 2 * size
            kept = ~alone[group[src]]
            src, dst = [values[src[kept]]], [values[dst[kept]]]
            for a, n in zip(edge[:-1][alone], size[alone], strict=True):
                own = np.unique(values[a : a + n], axis=0)
                root = _roots(own, most)
                joined = root != np.arange(len(own))
                src.append(own[joined])
                dst.append(own[root[joined]])
            return frame(np.concatenate(src), np.concatenate(dst), 0, False)

        points, values, flood = np.empty(0, np.int64), np.empty((0, len(names)), np.uint64), None
        for batch in batches:
            points = np.concatenate([points, batch["point"].to_numpy()])
            values = np.concatenate([values, np.stack([batch[n].to_numpy().view(np.uint64) for n in names], 1)])
            if flood is None and len(points) < AT_ONCE and not (cap and len(points) > cap and points[-cap - 1] == points[-1]):
                continue
            if flood is not None:
                more = points == flood
                if more.any():
                    yield frame(values[more], values[more], points[more], True)
                    points, values = points[~more], values[~more]
            if not len(points):
                continue
            flood = None
            last = np.searchsorted(points, points[-1])
            if last:
                yield link(points[:last], values[:last])
                points, values = points[last:], values[last:]
            if cap and len(points) > cap:
                flood = points[0]
                yield frame(values, values, points, True)
                points, values = points[:0], values[:0]
        if len(points):
            last = np.searchsorted(points, points[-1])
            if cap and len(points) - last > cap:
                yield frame(values[last:], values[last:], points[last:], True)
                points, values = points[:last], values[:last]
            if len(points):
                yield link(points, values)

    return meet, "src long, dst long, point long, crowded boolean, " + ", ".join(f"{n} long" for n in names)


def links(distinct: DataFrame, radius: int = RADIUS, most: int = RADIUS) -> DataFrame:
    """Links (src, dst: first fingerprints) among distinct rows of fingerprints; crowded rows are marked.

    Candidates are within ``radius`` bits in a fingerprint; they link if all fingerprints together
    differ by ``most`` bits at most. The work of a point is quadratic in its members but bounded by
    MOST_AT_POINT, and what it emits is linear.
    """
    names = [c for c in distinct.columns if c.startswith("fp")]
    segments = radius // 3 + 1
    sides = [(k, lo, 64 * (i + 1) // segments) for k in range(len(names)) for i in range(segments) for lo in [64 * i // segments]]

    def enter(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            columns = [batch[n].to_numpy().astype(np.int64) for n in names]
            for side, (k, lo, hi) in enumerate(sides):
                flips = np.concatenate([[0], 1 << np.arange(hi - lo)]).astype(np.uint64)
                part = columns[k].view(np.uint64) >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1)
                for a in range(0, len(part), 4096):
                    points = part[a : a + 4096, None] ^ flips | np.uint64(side << 40)
                    yield pd.DataFrame({"point": points.ravel().view(np.int64)} | {n: np.repeat(c[a : a + 4096], len(flips)) for n, c in zip(names, columns)})

    meet, schema = _meet(names, most, MOST_AT_POINT)
    # small rows that grow many times over: a fixed number of tasks, or AQE would leave a few only
    spread = distinct.select(*names).repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entered = spread.mapInPandas(enter, "point long, " + ", ".join(f"{n} long" for n in names))
    return entered.repartition("point").sortWithinPartitions("point").mapInPandas(meet, schema)


def block_links(crowded: DataFrame, most: int) -> DataFrame:
    """``src, dst`` within crowded points: members are dealt into blocks, and each pair of blocks is a
    task of its own that emits links which join its components only."""
    names = [c for c in crowded.columns if c.startswith("fp")]
    sizes = crowded.groupBy("point").agg(F.ceil(F.count(F.lit(1)) / (MOST_AT_POINT // 2)).alias("blocks"))
    own = crowded.join(sizes, "point").withColumn("own", F.pmod(F.xxhash64(*names), F.col("blocks")))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<long>")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    pairs = pairs.select(F.xxhash64("point", low, high).alias("point"), *names)
    meet, schema = _meet(names, most, None)
    return pairs.repartition("point").sortWithinPartitions("point").mapInPandas(meet, schema).select("src", "dst")


def hot_links(hot: DataFrame) -> DataFrame:
    """``src, dst`` among the fingerprints of column fp by the points of their balls of radius 2."""

    def enter(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        one = 1 << np.arange(64, dtype=np.uint64)
        a, b = np.triu_indices(64, 1)
        flips = np.concatenate([np.zeros(1, np.uint64), one, one[a] ^ one[b]])
        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            for x in range(0, len(fp), 128):
                points = fp[x : x + 128, None] ^ flips
                yield pd.DataFrame({"point": points.ravel().view(np.int64), "fp": np.repeat(fp[x : x + 128].view(np.int64), len(flips))})

    points = hot.mapInPandas(enter, "point long, fp long")
    ends = points.groupBy("point").agg(F.min("fp").alias("dst"), F.max("fp").alias("most")).where("dst < most")
    return points.join(ends, "point").where("fp <> dst").select(F.col("fp").alias("src"), "dst").distinct()


def components(prints: DataFrame, radius: int = RADIUS, most: int = RADIUS) -> DataFrame:
    """``fp, component`` for the first fingerprints that have a link."""
    names = [c for c in prints.columns if c.startswith("fp")]
    found = written(links(prints.select(*names).distinct(), radius, most), "simhash-links")
    edges = found.where("not crowded").select("src", "dst").distinct()
    crowded = found.where("crowded")
    if not crowded.isEmpty():
        exact = len(names) == 1 and most == RADIUS
        edges = edges.unionByName(hot_links(crowded.select("fp").distinct()) if exact else block_links(crowded.select("point", *names), most))
    return connected_components(edges).select(F.col("node").alias("fp"), "component")


def near_duplicates(documents: DataFrame, size: int = 4, radius: int = RADIUS, prints: int = 1, most: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``documents``; the smallest doc_id names a component."""
    rows = written(fingerprints(documents, size, prints), "simhash-prints")
    linked = components(rows, radius, most)
    per_print = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(linked, "fp", "left")
    per_print = written(per_print.select("fp", "least", F.coalesce("component", "fp").alias("label")), "simhash-labels")
    names = per_print.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows.join(per_print.join(names, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_hashes(data: bytes):
    """Sorted distinct shingle hashes of digests; without any the one hash 0."""
    import numpy as np

    return np.unique(np.frombuffer(data, ">u8").astype(np.uint64)) if data else np.zeros(1, np.uint64)


def set_name(hashes) -> int:
    """Signed 64-bit name of a shingle set."""
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(hashes.tobytes(), SEED), "big", signed=True)


class _Shingles:
    """Shingles of a chunk: 64-bit keys of all places in ascending order, with their documents."""

    def __init__(self, chunk: Chunk, size: int):
        import numpy as np

        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        chunk.data = lower[chunk.data]
        words = Words(chunk)
        key, inside = words.runs(size, np.uint64(RUN_BASE))
        place = np.flatnonzero(inside)
        order = np.argsort(key[place], kind="stable")
        self.key, self.doc = key[place][order], words.doc[place][order]
        self.words = words.ends - words.begins
        self.new = np.ones(len(order), bool)
        self.new[1:] = self.key[1:] != self.key[:-1]
        self.other = np.zeros(len(order), bool)  # the key before, in another document of the chunk
        self.other[1:] = ~self.new[1:] & (self.doc[1:] != self.doc[:-1])

    def distinct(self):
        """Keys, each once, and whether several documents of the chunk have it."""
        import numpy as np

        return self.key[self.new], np.bincount(np.cumsum(self.new) - 1, self.other, int(self.new.sum())) > 0


def suspects(documents: DataFrame, size: int, similarity: float, prints: int) -> DataFrame:
    """``doc_id, node, n, fp ..., own`` of the documents that can have a near copy: name, size and fingerprints of the
    shingle set, and the set.

    A document with a near copy shares ``similarity`` of its own shingles with it at least, so all others, most of a
    corpus, are left out without loss: those with fewer shingles that occur in a second document. Keys are
    shuffled for that, packed, and no texts. Documents of fewer words than a shingle always go on.
    """
    chunks = make_chunks(documents)
    total = chunks.agg(F.sum("words")).first()[0] or 0
    parts = max(1, -(-total // RANGE_KEYS))
    names = ["fp", *[f"fp{k}" for k in range(1, prints)]]

    def send(chunk: Chunk, _: dict) -> Iterator:
        import numpy as np
        import pandas as pd

        key, several = _Shingles(chunk, size).distinct()
        low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows = [(chunk.id, r, low[a:b].tobytes(), np.packbits(several[a:b]).tobytes()) for r, a, b in cuts(ranges(key, parts), parts)]
        yield pd.DataFrame(rows, columns=["chunk", "range", "keys", "several"])

    def judge(rows) -> list[bytes]:
        import numpy as np

        keys, sizes = join_arrays(rows["keys"], np.uint32)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows["several"], sizes, strict=True)])
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        times = np.add.reduceat(1 + several[order].astype(np.int64), np.flatnonzero(new))
        shared = np.empty(len(keys), bool)
        shared[order] = (times > 1)[np.cumsum(new) - 1]
        return [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum(sizes)[:-1])]

    def select(chunk: Chunk, answers: dict) -> Iterator:
        import numpy as np
        import pandas as pd

        own = _Shingles(chunk, size)
        key, _ = own.distinct()
        shared = np.zeros(len(key), bool)
        for r, a, b in cuts(ranges(key, parts), parts):
            shared[a:b] = np.unpackbits(np.frombuffer(answers[r], np.uint8), count=b - a).astype(bool)
        once = own.new | own.other  # a shingle of a document counts once
        docs = len(chunk.ids)
        has = np.bincount(own.doc[once], minlength=docs)
        common = np.bincount(own.doc[once], shared[np.cumsum(own.new) - 1][once], docs)
        bits, rows = _bits(), []
        for k in np.flatnonzero((own.words <= size) | (common >= similarity * has - 1e-9)).tolist():
            data = shingle_digests(chunk.body[chunk.begins[k] : chunk.ends[k]].lower(), size)
            hashes = distinct_hashes(data)
            rows.append((chunk.ids[k], set_name(hashes), len(hashes), *digest_prints(hashes.astype(">u8").tobytes() if data else b"", bits, prints), hashes.view(np.int64)))
        frame = pd.DataFrame(rows, columns=["doc_id", "node", "n", *names, "own"])
        frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64")
        yield frame

    shared = by_range(over_chunks(chunks, send, "chunk long, range long, keys binary, several binary"), judge, "near-shared")
    out = over_chunks(chunks, select, "doc_id long, node long, n long, " + ", ".join(f"{n} long" for n in names) + ", own array<long>", shared)
    return written(out.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType)), "near-suspects")


def similar_rows(sets: list, similarity: float) -> tuple[list[int], list[int]]:
    """Links that span the components of all pairs of ``sets`` (sorted arrays) with that Jaccard similarity."""
    import numpy as np

    n = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(n)])
    postings = np.repeat(np.arange(len(sets)), n)[np.argsort(ids, kind="stable")]
    df = np.bincount(ids)
    first = np.concatenate([[0], np.cumsum(df)])
    mark, todo, src, dst = np.zeros(len(df), bool), np.ones(len(sets), bool), [], []
    for root in range(len(sets)):
        if not todo[root]:
            continue
        todo[root], reach = False, [root]
        while reach:
            v = reach.pop()
            rest = np.flatnonzero(todo & (n >= similarity * n[v] - 1e-9) & (similarity * n <= n[v] + 1e-9))
            if not len(rest):
                continue
            own = ids[start[v] : start[v + 1]]
            if n[rest].sum() < df[own].sum():
                mark[own] = True
                edge = np.concatenate([[0], np.cumsum(n[rest])])
                place = np.arange(edge[-1]) + np.repeat(start[rest] - edge[:-1], n[rest])
                both = np.add.reduceat(mark[ids[place]].astype(np.int64), edge[:-1])
                mark[own] = False
            else:
                both = np.zeros(len(sets), np.int64)
                for a in range(0, len(own), 256):
                    both += np.bincount(np.concatenate([postings[first[i] : first[i + 1]] for i in own[a : a + 256]]), minlength=len(sets))
                both = both[rest]
            near = rest[both >= similarity * (n[rest] + n[v] - both) - 1e-9]
            todo[near] = False
            reach += near.tolist()
            src += [v] * len(near)
            dst += near.tolist()
    return src, dst


def similar_links(sets: DataFrame, dealt: DataFrame, similarity: float) -> DataFrame:
    """``src, dst``: links between shingle sets (``node, own``) of one candidate component (``node, component, blocks``), all verified.

    Sets of a large component are dealt into blocks of about BLOCK_SHINGLES, and each pair of blocks is a task of its own.
    """

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        def linked():
            found = similar_rows(held, similarity) if len(held) > 1 else ([], [])
            src.extend(nodes[k] for k in found[0])
            dst.extend(nodes[k] for k in found[1])

        task, nodes, held = None, [], []
        src, dst = [], []
        for batch in batches:
            for t, node, own in zip(batch["task"], batch["node"], batch["own"], strict=True):
                if t != task:
                    linked()
                    task, nodes, held = t, [], []
                nodes.append(node)
                held.append(np.array(own).view(np.uint64))
            yield pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})
            src, dst = [], []
        linked()
        yield pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    once = sets.join(bounded(dealt), "node").groupBy("node", "component", "blocks").agg(F.first("own").alias("own"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = once.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<long>")))
    task = F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("task")
    spread = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select(task, "node", "own").repartition(spread, "task").sortWithinPartitions("task", "node").mapInPandas(compare, "src long, dst long")


def similar(documents: DataFrame, size: int, similarity: float, prints: int = PRINTS, radius: int = WIDE, most: int = MOST_BITS) -> DataFrame:
    """``doc_id, component_id`` of the documents that can have a near copy: components of the pairs whose shingle sets have
    the Jaccard similarity.

    Candidate components come from multi-index hashing of ``prints`` fingerprints; in there links are verified on complete sets.
    """
    rows = suspects(documents, size, similarity, prints)
    names = [c for c in rows.columns if c.startswith("fp")]
    linked = components(rows.select(*names), radius, most)
    nodes = rows.select("node", "n", "fp").distinct().join(linked, "fp", "left").select("node", "n", F.coalesce("component", "fp").alias("component"))
    nodes = written(nodes, "near-candidates")
    blocks = nodes.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("blocks"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    dealt = written(nodes.select("node", "component").join(blocks.drop("sets"), "component"), "near-dealt")
    found = connected_components(written(similar_links(rows.select("node", "own"), dealt, similarity), "near-links"))
    per_set = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left")
    per_set = written(per_set.select("node", "least", F.coalesce("component", "node").alias("label")), "near-labels")
    least = per_set.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(per_set.join(least, "label").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(documents: DataFrame, size: int = 5, similarity: float = SIMILAR) -> DataFrame:
    """The rows of ``documents`` that stay, all columns: of each component of similar documents those with the smallest doc_id.

    A doc_id that names both the smallest and another member of components keeps all its rows.
    """
    found = written(similar(documents, size, similarity), "near-found")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stay = found.where(kept).select(F.col("doc_id").alias("_stay")).distinct()
    gone = found.where(~kept).select(F.col("doc_id").alias("_gone")).distinct()
    gone = gone.join(stay, F.col("_gone").eqNullSafe(F.col("_stay")), "left_anti")
    return without(documents, written(gone, "near-gone"), "doc_id")
