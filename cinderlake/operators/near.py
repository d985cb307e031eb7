"""Pairs of 64-bit fingerprints within a few bits, by a pigeonhole whose thresholds follow the data.

The bits are cut into segments, and each segment gets a radius. If the radii plus one add up to one more than the
distance asked for, then a pair within that distance is within the radius in one segment at least (a radius of -1 leaves a segment out).
Fingerprints of one language agree in many bits; a segment of such bits would compare crowds each with each. So bits, cuts and radii are chosen by
cost: rows to probe plus pairs that meet, estimated from the distances within a bounded sample of fingerprints. The choice decides
the work only; every pair is found with any of them.

In crowds that agree in most bits any segment brings many together that aren't near. Where comparing each with each costs less than that, fingerprints are
packed into blocks and pairs of blocks are compared in place (:func:`block_pairs`): nothing but the pairs found is written or shuffled.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cinderlake.functions.text import hamming
from cinderlake.session import written

#: Fingerprints that the costs are estimated from, at most; cost of a pair that meets, and of one that blocks compare, in probing rows.
SAMPLE, PAIR_COST, COMPARED_COST = 1200, 0.1, 0.001

#: Fingerprints of a block at most; blocks at least, if they have so many fingerprints each; pairs that a task holds at once.
MOST_BLOCK, LEAST_BLOCKS, LEAST_BLOCK, HELD = 20_000, 10, 500, 200_000

#: Rows and columns that are compared at once; a multiple of eight together.
TILE = 128, 1024


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _ball(bits: list[int], radius: int) -> list[int]:
    """All sets of up to ``radius`` of the bits."""
    return [_signed(sum(1 << b for b in some)) for k in range(radius + 1) for some in combinations(bits, k)]


def segments(sample, n: int, most: int) -> list[tuple[list[int], int]]:
    """(bits, radius) of the cheapest cut for ``n`` fingerprints of which ``sample`` (64-bit numbers) are some; those left out aren't listed."""
    return _cheapest(sample, n, most)[1]


def _cheapest(sample, n: int, most: int) -> tuple[float, list[tuple[list[int], int]]]:
    """The cost of :func:`segments`, in probing rows, and these."""
    sample = np.asarray(sample, np.uint64)
    i, j = np.triu_indices(len(sample), 1)
    apart = sample[i] ^ sample[j]
    share = np.array([((sample >> np.uint64(b)) & np.uint64(1)).mean() if len(sample) else 0.5 for b in range(64)])
    by_spread = np.argsort(np.abs(share - 0.5), kind="stable").tolist()
    best: tuple[float, list] = (np.inf, [])
    for parts in range(1, most + 2):
        cuts = [64 * k // parts for k in range(parts + 1)]
        for bits in ([by_spread[a:b] for a, b in zip(cuts, cuts[1:])], [by_spread[k::parts] for k in range(parts)]):
            # cost of each segment by radius; then the radii with the least total, radius + 1 being what is spent of most + 1
            table = []
            for own in bits:
                mask = np.uint64(sum(1 << b for b in own))
                near = np.bincount(np.bitwise_count(apart & mask), minlength=65).cumsum() / max(len(apart), 1)
                cost = [0.0]
                for r in range(most + 1):
                    probes = sum(comb(len(own), k) for k in range((r + 1) // 2 + 1)) + sum(comb(len(own), k) for k in range(r // 2 + 1))
                    chance = max(near[r], sum(comb(len(own), k) for k in range(r + 1)) / 2 ** len(own))
                    cost.append(n * probes + PAIR_COST * n * n * chance if probes < 20_000 else np.inf)
                table.append(cost)
            total = {0: (0.0, [])}
            for cost in table:
                step: dict = {}
                for spent, (c, radii) in total.items():
                    for r in range(-1, most - spent + 1):
                        key, new = spent + r + 1, c + cost[r + 1]
                        if new < step.get(key, (np.inf,))[0]:
                            step[key] = (new, [*radii, r])
                total = step
            if most + 1 in total and total[most + 1][0] < best[0]:
                best = (total[most + 1][0], [(own, r) for own, r in zip(bits, total[most + 1][1]) if r >= 0])
    return best


def _costs(groups: DataFrame, fp: str, most: int) -> tuple[int, float, list[tuple[list[int], int]]]:
    """How many fingerprints a table of distinct ones has, and :func:`_cheapest` for it."""
    rows, n = groups.select(fp).orderBy(F.xxhash64(fp)).limit(SAMPLE).collect(), groups.count()
    return n, *_cheapest([r[0] % (1 << 64) for r in rows], n, most)


def plan(groups: DataFrame, fp: str, most: int) -> list[tuple[list[int], int]]:
    """:func:`segments` for a table of distinct fingerprints."""
    return _costs(groups, fp, most)[2]


def _lowest(bits: Column, k: int) -> Column:
    """The ``k`` lowest bits that are set."""
    rest = bits
    for _ in range(k):
        # the least number has no predecessor in 64 bits; there it wraps around
        rest = rest.bitwiseAND(F.coalesce(F.try_subtract(rest, F.lit(1).cast("long")), F.lit((1 << 63) - 1)))
    return bits.bitwiseXOR(rest)


def meetings(groups: DataFrame, fp: str, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """``a, b, fa, fb``: pairs (a < b) of rows that are near in a segment, each once.

    Of all the points at which two rows meet, one counts: in the first segment in which they are near, that which the left one reaches by the lowest of the
    bits in which they differ. So nothing has to be made distinct. The keys are many times the table, which Spark's estimate doesn't know: they are joined by
    a sort and never broadcast.
    """
    masks = [_signed(sum(1 << b for b in bits)) for bits, _ in chosen]

    def side(radius, whose: str, print_: str) -> DataFrame:
        def around(no: int, bits: list[int], r: int) -> Column:
            own = F.col(fp).bitwiseAND(F.lit(masks[no]))
            return F.transform(F.array(*[F.lit(m) for m in _ball(bits, r)]), lambda m: F.struct(own.bitwiseXOR(m).alias("v"), F.lit(no).alias("no")))

        keys = [around(no, bits, radius(r)) for no, (bits, r) in enumerate(chosen)]
        return groups.select(F.col("id").alias(whose), F.col(fp).alias(print_), F.inline(F.flatten(F.array(*keys))))

    # balls of unlike radii aren't symmetric, but the left row has the larger one whichever of a pair it is
    left, right = side(lambda r: (r + 1) // 2, "a", "fa"), side(lambda r: r // 2, "b", "fb")
    apart = F.col("fa").bitwiseXOR(F.col("fb"))
    counts = F.lit(False)
    for no, (_, r) in enumerate(chosen):
        own = apart.bitwiseAND(F.lit(masks[no]))
        here = (F.col("no") == no) & (F.col("v") == F.col("fa").bitwiseAND(F.lit(masks[no])).bitwiseXOR(_lowest(own, (r + 1) // 2)))
        for before, (_, radius) in zip(masks[:no], chosen[:no]):
            here = here & (F.bit_count(apart.bitwiseAND(F.lit(before))) > radius)
        counts = counts | here
    return left.hint("merge").join(right, ["v", "no"]).where("a < b").where(counts).select("a", "b", "fa", "fb")


def _blocks(groups: DataFrame, fp: str, n: int, label: str) -> DataFrame:
    """``own, ids, fps``: ``n`` rows (id, fp) packed into blocks, one row of a written table each."""
    blocks = max(1, -(-n // min(MOST_BLOCK, max(LEAST_BLOCK, n // LEAST_BLOCKS))))

    def pack(batches):
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if batches:
            part = pa.Table.from_batches(batches)
            columns = [part.column(c).to_numpy().tobytes() for c in ("id", "fp")]
            yield pa.RecordBatch.from_arrays([part.column("own").chunk(0)[:1], *[pa.array([c], pa.binary()) for c in columns]], ["own", "ids", "fps"])

    rows = groups.select(F.pmod(F.xxhash64(fp), F.lit(blocks)).cast("int").alias("own"), F.col("id").cast("long").alias("id"), F.col(fp).alias("fp"))
    return written(rows.repartitionById(blocks, "own").mapInArrow(pack, "own int, ids binary, fps binary"), label)


def _crossed(x: DataFrame, y: DataFrame, once: str, run, schema: str) -> DataFrame:
    """``run(x, y)``, an iterator of lists of columns, for each pair of blocks (own, ids, fps) for which ``once`` holds; nothing is shuffled."""
    x, y = (side.select(*[F.col(c).alias(f"{name}_{c}") for c in ("own", "ids", "fps")]) for side, name in ((x, "x"), (y, "y")))

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                own_x, own_y = batch.column(0)[r].as_py(), batch.column(3)[r].as_py()
                sides = [(own, *[np.frombuffer(batch.column(c + k)[r].as_buffer(), kind) for k, kind in enumerate((np.int64, np.uint64))]) for own, c in ((own_x, 1), (own_y, 4))]
                for columns in run(*sides):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in schema.split(", ")])

    return x.join(y.hint("shuffle_replicate_nl"), F.expr(once)).mapInArrow(each, schema)


def block_pairs(groups: DataFrame, fp: str, n: int, most: int) -> DataFrame:
    """``a, b``: ids (a < b) of the ``n`` distinct fingerprints within ``most`` bits, each pair once, by comparing blocks with each other."""

    def run(x: tuple, y: tuple):
        (own_x, ids_x, fps_x), (own_y, ids_y, fps_y) = x, y
        high, wide = TILE
        apart, bits, near = np.empty(high * wide, np.uint64), np.empty(high * wide, np.uint8), np.zeros(high * wide + 8, bool)
        words, eights, eight, left, right, held = near[:-8].view(np.uint64), near[:-8].reshape(-1, 8), np.arange(8), [], [], 0
        for c in range(0, len(fps_y), wide):
            w = fps_y[c : c + wide]
            for r in range(0, len(fps_x), high):
                v = fps_x[r : r + high, None]
                n = len(v) * len(w)
                np.bitwise_xor(v, w, out=apart[:n].reshape(len(v), len(w)))
                np.bitwise_count(apart[:n], out=bits[:n])
                np.less_equal(bits[:n], most, out=near[:n])
                near[n : n + 8] = False
                # eight at a time: few are near
                some = np.flatnonzero(words[: -(-n // 8)])
                i, j = np.divmod((some[:, None] * 8 + eight)[eights[some]], len(w))
                i, j = i + r, j + c
                if own_x == own_y:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                left.append(ids_x[i])
                right.append(ids_y[j])
                held += len(i)
                if held >= HELD:
                    yield _ends(left, right)
                    left, right, held = [], [], 0
        if held:
            yield _ends(left, right)

    def _ends(left: list, right: list) -> list:
        a, b = np.concatenate(left), np.concatenate(right)
        return [np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]]

    blocks = _blocks(groups, fp, n, "near-blocks")
    return _crossed(blocks, blocks, "(x_own < y_own) = ((x_own + y_own) % 2 = 1)", run, "a long, b long")


def near_any(groups: DataFrame, others: DataFrame, fp: str, most: int) -> DataFrame:
    """``fp``: fingerprints of ``groups`` (id, fp) within ``most`` bits of any of ``others``, once at least each; pairs aren't listed."""

    def run(x: tuple, y: tuple):
        fps, found = y[2], []
        for a in range(0, len(x[2]), 500):
            apart, bits, least = np.empty(len(fps), np.uint64), np.empty(len(fps), np.uint8), np.full(len(fps), 64, np.uint8)
            for v in x[2][a : a + 500]:
                np.bitwise_xor(fps, v, out=apart)
                np.bitwise_count(apart, out=bits)
                np.minimum(least, bits, out=least)
            found.append(fps[least <= most])
            fps = fps[least > most]
        yield [np.concatenate(found).view(np.int64)]

    x, y = (_blocks(df, fp, df.count(), "near-blocks") for df in (others, groups))
    return _crossed(x, y, "true", run, "fp long")


def near_pairs(prints: DataFrame, id_col: str, fp: str, most: int = 6) -> DataFrame:
    """``a, b``: fingerprints of up to ``most`` differing bits.

    Equal fingerprints are collapsed: a pair links the smallest ids of two fingerprints, and members of one
    fingerprint link to its smallest id. Ids that aren't whole numbers are never packed into blocks.
    """
    groups = written(prints.groupBy(fp).agg(F.min(id_col).alias("id")), "near-groups")
    n, cost, chosen = _costs(groups, fp, most)
    kind = groups.schema["id"].dataType
    if n and isinstance(kind, IntegralType) and COMPARED_COST * n * n / 2 < cost:
        pairs = block_pairs(groups, fp, n, most).select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    elif n:
        pairs = meetings(groups, fp, chosen).where(hamming(F.col("fa"), F.col("fb")) <= most).select("a", "b")
    else:
        pairs = groups.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    if not groups.groupBy("id").count().where("count > 1").isEmpty():  # an id that names several fingerprints
        pairs = pairs.distinct()
    same = prints.join(groups.withColumnRenamed("id", "_least"), fp).where(F.col(id_col) != F.col("_least")).select(F.col("_least").alias("a"), F.col(id_col).alias("b"))
    return pairs.unionByName(same)
