"""Pairs of dense vectors from a cosine on, by metric pivots.

Angles between unit vectors are a metric. Every vector lives in the cell of its nearest pivot. Two vectors within
``limit`` of each other: by the triangle inequality one is no farther from the other's pivot than that cell's radius plus
``limit``, so it visits that cell. A pair is compared in the cell of the smaller number only. Within a cell both are in the order of their angle to the
pivot, and tiles whose angles differ by more than ``limit`` are passed over. Pivots come from a bounded sample by farthest
points first; they decide the work only. Cells and their visitors are dealt into blocks, and each pair of blocks is a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.session import written

#: Rows that pivots are chosen from, and pivots, at most; rows of a block, and of a tile within it.
SAMPLE, MOST_PIVOTS, BLOCK, TILE = 4096, 512, 4000, 128
#: Angles are rounded; what is that near to a bound is compared.
SLACK = 1e-6


def _unit(vectors):
    m = np.stack(list(vectors)).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def farthest_first(rows, k: int):
    """Up to ``k`` rows, each the farthest from those before; fewer where all others are copies."""
    chosen, nearest = [0], rows @ rows[0]
    while len(chosen) < k:
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-9:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, rows @ rows[at])
    return rows[chosen]


def worthwhile(sample, k: int, limit: float):
    """Pivots for a sample, or a single one where they would save under half of the comparisons: then cells only cost."""
    points = farthest_first(sample, k)
    every = np.arccos(np.clip(sample @ points.T, -1, 1))
    home = every.argmin(1)
    radius = np.array([every[home == c, c].max(initial=0) for c in range(len(points))])
    visits = (every <= radius + limit) & (np.arange(len(points)) < home[:, None])
    size = np.bincount(home, minlength=len(points))
    share = float((size * (size / 2 + visits.sum(0))).sum()) / max(len(sample) ** 2 / 2, 1)
    return points if share < 0.5 else points[:1]


def cells(rows: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Members ``cell, id, v, angle`` (v of length 1), and the visits ``cell, id, v, angle`` to cells of smaller numbers."""
    spark = rows.sparkSession
    some = [r["v"] for r in rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").collect()]
    total = rows.count()
    width = len(some[0]) if some else 0
    points = worthwhile(_unit([v for v in some if len(v) == width and any(v)] or [some[0]]), min(MOST_PIVOTS, max(1, math.isqrt(total))), limit) if some else np.empty((0, 0))
    pivots = spark.sparkContext.broadcast(points)

    def angles(unit):
        return np.arccos(np.clip(unit @ pivots.value.T, -1, 1))

    def settle(batches: Iterator) -> Iterator:
        for batch in batches:
            batch = batch[[limit >= math.pi / 2 or any(v) for v in batch["v"]]]  # zeros are at a right angle to all
            if len(batch):
                unit = _unit(batch["v"])
                every = angles(unit)
                yield pd.DataFrame({"cell": every.argmin(1), "id": batch["id"], "v": list(unit), "angle": every.min(1)})

    members = written(rows.where(F.size("v") == width).mapInPandas(settle, "cell long, id long, v array<double>, angle double"), "dense-members")
    radius = np.full(len(points), -np.inf)
    for r in members.groupBy("cell").agg(F.max("angle").alias("r")).collect():
        radius[r["cell"]] = r["r"]

    def visit(batches: Iterator) -> Iterator:
        for batch in batches:
            if len(batch):
                unit = np.stack(batch["v"].tolist())
                every = angles(unit)
                who, where = np.nonzero((every <= radius + limit + SLACK) & (np.arange(len(points)) < batch["cell"].to_numpy()[:, None]))
                yield pd.DataFrame({"cell": where, "id": batch["id"].to_numpy()[who], "v": [batch["v"].iloc[k] for k in who], "angle": every[who, where]})

    if len(points) < 2:
        return members, members.where("false").select("cell", "id", "v", "angle")
    return members, members.mapInPandas(visit, "cell long, id long, v array<double>, angle double")


def dense_pairs(vectors: DataFrame, id_col: str, vector: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """``a, b, cosine`` of all pairs at or over ``threshold``, each once.

    Vectors of another length than the first sampled one, and null ones, match nothing.
    """
    return compared(vectors, id_col, vector, threshold, block).where("a IS NOT NULL").select("a", "b", "cosine")


def compared(vectors: DataFrame, id_col: str, vector: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """The pairs, and rows with null ids whose ``cosine`` is the number of pairs that a task multiplied."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    limit = math.acos(min(1.0, max(-1.0, threshold)))
    members, visits = cells(rows, limit)
    of = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias(name))
    sizes = written(of(members, "own").join(of(visits, "others"), "cell", "left").select("cell", "own", F.coalesce("others", F.lit(0)).cast("long").alias("others")), "dense-sizes")
    # rows 0 .. own - 1 are blocks of members, rows own .. own + others - 1 of visitors; members meet members of no smaller block, and all visitors
    all_of = members.select("cell", "id", "v", "angle", F.lit(False).alias("guest")).unionByName(visits.select("cell", "id", "v", "angle", F.lit(True).alias("guest"))).join(F.broadcast(sizes), "cell")
    hashed = F.xxhash64("id")
    line = F.when(F.col("guest"), F.col("own") + F.pmod(hashed, F.greatest("others", F.lit(1)))).otherwise(F.pmod(hashed, F.col("own")))
    met = F.when(F.col("guest"), F.sequence(F.lit(0).cast("long"), F.col("own") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("own") + F.col("others") - 1))
    dealt = all_of.withColumn("line", line.cast("long")).withColumn("other", F.explode(met))
    dealt = dealt.select("cell", F.least("line", "other").alias("x"), F.greatest("line", "other").alias("y"), "line", "id", "v", "angle")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        x, y = int(part["x"].iloc[0]), int(part["y"].iloc[0])
        part = part.sort_values(["angle", "id"])
        left, right = part[part["line"] == x], part[part["line"] == y]
        a, b, cosine, n = [], [], [], 0
        if len(left) and len(right):
            lu, ru, la, ra = np.stack(left["v"].tolist()), np.stack(right["v"].tolist()), left["angle"].to_numpy(), right["angle"].to_numpy()
            li, ri = left["id"].to_numpy(), right["id"].to_numpy()
            for k in range(0, len(left), TILE):
                first = k if x == y else 0
                low = max(first, int(np.searchsorted(ra, la[k] - limit - SLACK)))
                high = int(np.searchsorted(ra, la[min(k + TILE, len(left)) - 1] + limit + SLACK, "right"))
                if low >= high:
                    continue
                dots = lu[k : k + TILE] @ ru[low:high].T
                n += dots.size
                i, j = np.nonzero(dots >= threshold)
                keep = (j + low > i + k) if x == y else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                a.append(np.minimum(li[i + k], ri[j + low]))
                b.append(np.maximum(li[i + k], ri[j + low]))
                cosine.append(dots[i, j])
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        out = pd.DataFrame({"a": pd.array(cat(a, np.int64), dtype="Int64"), "b": pd.array(cat(b, np.int64), dtype="Int64"), "cosine": cat(cosine, float)})
        return pd.concat([out, pd.DataFrame({"a": pd.array([None], dtype="Int64"), "b": pd.array([None], dtype="Int64"), "cosine": [float(n)]})])

    return dealt.groupBy("cell", "x", "y").applyInPandas(compare, "a long, b long, cosine double")
