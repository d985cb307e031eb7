"""How five filters interact: what each removes, alone and after others, in every order.

Filter E (a copy of a text with a smaller id) needs the texts of the whole table to meet. Texts are range-partitioned by
adaptive prefixes: a range that holds more than ``capacity`` bytes is cut at longer prefixes, until it fits or has a single
text. The owner of a range inserts its full texts into a compressed trie with the smallest id at
each terminal; a walk over the terminals tells copies.

1. Prefixes: bytes per prefix of 2, 4, 8 ... characters, of which only those that are too full go on. The cuts are
   collected: some per ``capacity`` bytes, so ``capacity`` grows with the corpus where there would be over ``MOST_CUTS``.
2. Each task inserts its texts into small tries of its own first. Per terminal one row leaves it: the text, the failures
   that the text decides, the smallest id, and how many rows of each part, quality and toxicity have that id or another. So copies, however many,
   cost a range one row per task.
3. Ranges merge those rows and reduce them to counts by part and failure mask. All 120 orders follow from at most 32 masks a part.

Defined results: a null text counts as empty, a null lang as the part ''. A row without a doc_id is no copy and makes no copies. Of rows with
equal id and text none is a copy by the other. A label counts if any row of ``labels`` for that doc_id has it. Texts of any length are taken
whole. An empty table gives no rows. Columns besides doc_id, text and lang (labels: doc_id, quality, toxic) are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import bounded
from cinderlake.llm.tries import Trie
from cinderlake.session import written

FILTERS = "ABCDE"
#: Bytes of text in a range and in a task's own trie; cuts between ranges, at most; characters of the first prefixes; rows taken out of a batch at once.
CAPACITY, OWN_BYTES, MOST_CUTS, FIRST_PREFIX, ROWS_AT_ONCE = 32_000_000, 8_000_000, 100_000, 2, 200
UPPER, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: How a row's id stands to the smallest of its text.
LEAST, LATER, NO_ID = 0, 1, 2


def failures(text: bytes) -> int:
    """Filters A to D that a text fails, as bits 0 to 3."""
    words = text.split()
    points = len(text.decode("utf-8", "surrogatepass"))
    a, b = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    c = 100 * (len(text) - len(text.translate(None, UPPER))) > 3 * points
    return a | b << 1 | c << 2 | (len(text.translate(None, MARKS)) != len(text)) << 3


def merged(one: list, two: list) -> list:
    """Terminals ``[mask, smallest id or None, {(state, part, label): rows}]`` of one text put together."""
    small, other = (one, two) if two[1] is None or one[1] is not None and one[1] <= two[1] else (two, one)
    later = other[1] is not None and other[1] != small[1]
    for (state, part, label), n in other[2].items():
        key = (LATER if later and state == LEAST else state, part, label)
        small[2][key] = small[2].get(key, 0) + n
    return small


def _values(batch) -> Iterator[tuple]:
    """Rows of an Arrow batch as tuples, of few at a time as Python values."""
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield from zip(*[c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns], strict=True)


def prefix_cuts(texts: DataFrame, capacity: int = CAPACITY) -> list[str]:
    """Where ranges of texts begin, ascending, for a table with the column ``text``.

    A range has up to three times ``capacity`` bytes of different texts, unless a single text is longer; copies aren't counted apart.
    """
    size = F.octet_length("text").cast("long")
    total = texts.agg(F.sum(size)).first()[0] or 0
    capacity = max(capacity, 2 * total // MOST_CUTS)
    cuts, length, left, parents = set(), FIRST_PREFIX, texts, None
    while True:
        prefix = F.substring("text", 1, length)
        parent = F.substring("text", 1, length // 2 if parents else 0)
        sizes = left.groupBy(parent.alias("parent"), prefix.alias("prefix")).agg(F.sum(size).alias("bytes"), F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
        sizes = written(sizes, "audit-prefixes")
        before = "sum(bytes) OVER (PARTITION BY parent ORDER BY prefix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - bytes"
        begins = sizes.select("parent", "prefix", F.expr(f"({before}) div {capacity}").alias("range")).groupBy("parent", "range").agg(F.min("prefix").alias("prefix"))
        full = F.col("bytes") > capacity
        cuts |= {r["prefix"] for r in begins.select("prefix").collect()}
        parents = [r["prefix"] for r in sizes.where(full & (F.col("low") != F.col("high"))).select("prefix").collect()]
        if not parents:
            return sorted(cuts - {""}, key=lambda c: c.encode("utf-8", "surrogatepass"))
        known = texts.sparkSession.createDataFrame([(p,) for p in parents], "_full string")
        left = texts.join(F.broadcast(known), F.substring("text", 1, length) == F.col("_full"), "left_semi")
        length *= 2


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, part, label``; label has bit 0 for quality 1 and bit 1 for toxic 1. Texts aren't shuffled for few labels."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    bit = lambda c, v: F.max(F.when(F.col(c) == 1, v).otherwise(0))
    some = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((bit("quality", 1) + bit("toxic", 2)).alias("label"))
    out = rows.join(bounded(written(some, "audit-labels")), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    return out.withColumn("label", F.coalesce("label", F.lit(0)).cast("int"))


def masks(documents: DataFrame, labels: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``part, mask, label, n``: rows by the filters that they fail."""
    rows = labelled(documents, labels)
    cuts = [c.encode("utf-8", "surrogatepass") for c in prefix_cuts(rows.select("text"), capacity)]
    entry = "range long, text binary, mask int, least long, states array<int>, parts array<string>, labels array<int>, counts array<long>"

    def local(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(trie: Trie):
            for text, (mask, least, counts) in trie.walk():
                keys = list(counts)
                held.append((bisect_right(cuts, text), text, mask, least, [k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], list(counts.values())))
                size[0] += len(text) + 64
                if size[0] > 4_000_000:
                    yield batch_of()
            if held:
                yield batch_of()

        def batch_of():
            columns = list(zip(*held, strict=True))
            held.clear()
            size[0] = 0
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["range", "text", "mask", "least", "states", "parts", "labels", "counts"])

        held, size, trie = [], [0], Trie(merged)
        for batch in batches:
            for doc, text, part, label in _values(batch):
                own = text.encode("utf-8", "surrogatepass")
                trie.insert(own, [failures(own), doc, {(NO_ID if doc is None else LEAST, part, label): 1}])
                if trie.bytes > OWN_BYTES:
                    yield from out(trie)
                    trie = Trie(merged)
        yield from out(trie)

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def close():
            for mask, _, counts in trie.values():
                for (state, part, label), n in counts.items():
                    key = (part, mask | (state == LATER) << 4, label)
                    total[key] = total.get(key, 0) + n

        trie, now, total = Trie(merged), None, {}
        for batch in batches:
            for number, text, mask, least, *counts in _values(batch):
                if number != now:
                    close()
                    trie, now = Trie(merged), number
                trie.insert(text, [mask, least, {(s, p, k): n for s, p, k, n in zip(*counts, strict=True)}])
        close()
        rows = [(*k, n) for k, n in total.items()]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "mask", "label", "n"])

    spread = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), (len(cuts) + 4) // 4)
    dealt = rows.mapInArrow(local, entry).repartition(spread, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(judge, "part string, mask int, label int, n long").groupBy("part", "mask", "label").agg(F.sum("n").alias("n"))


def orders(counts: DataFrame) -> DataFrame:
    """The contract's rows from ``part, mask, label, n``."""
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    every = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    steps = counts.select("part", "mask", "label", "n", every.alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letters = F.expr(f"transform(sequence(1, {len(FILTERS)}), k -> shiftleft(1, ascii(substr(filter_order, k, 1)) - {ord('A')}))")
    own = F.element_at(letters, F.col("step"))
    earlier = F.aggregate(F.slice(letters, 1, F.col("step") - 1), F.lit(0), lambda a, b: a.bitwiseOR(b))
    steps = steps.select("*", own.alias("own"), earlier.alias("earlier"))
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    removed = fails & ~gone
    # of the orders of the filters that a row fails, each of these comes first in an equal share
    share = F.lit(120) / F.bit_count("mask") * F.col("n")
    return steps.groupBy("part", "filter_order", "step").agg(
        some(~fails & ~gone).alias("kept"), some(removed).alias("removed"), some(fails & gone).alias("redundant"),
        some(F.col("mask") == F.col("own")).alias("unique_fails"),
        some(removed & (F.col("label").bitwiseAND(F.lit(1)) != 0)).alias("good_lost"), some(removed & (F.col("label").bitwiseAND(F.lit(2)) != 0)).alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, share.cast("long"))), F.lit(0)).cast("long").alias("shapley"),
    )


def op12_filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    return orders(written(masks(documents, labels), "audit-masks"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 200, 100 * list_unique(w) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)
),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
f(x) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM f a, f b, f c, f d, f e WHERE list_unique([a.x, b.x, c.x, d.x, e.x]) = 5),
s AS (
  SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, x AS step, o[x] AS own, n, good, toxic,
         fails[o[x]] AS fails, len(list_filter(o[1:x - 1], lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda b: b)) = 1 AND fails[o[x]] AS lone
  FROM c, o, f
),
g AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN lone THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails AND NOT gone THEN n * good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g
"""
