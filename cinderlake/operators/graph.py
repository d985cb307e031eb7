"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.session import written

#: Edges that a task contracts before the rounds; more edges, more tasks.
TASK_EDGES = 400_000


def _forest(batches):
    """Edges of one task as stars: every node of a tree to its smallest."""
    root: dict = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    stars = [(x, find(x)) for x in list(root)]
    yield pd.DataFrame([s for s in stars if s[0] != s[1]], columns=["u", "v"])


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (u, v) with the same components. Edges are dealt evenly, so each task takes about TASK_EDGES at most."""
    return edges.repartition(max(1, -(-edges.count() // TASK_EDGES))).mapInPandas(_forest, edges.schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node that has an edge; component is the smallest node.

    Each round halves the depth of the trees at least, so a chain of n nodes takes about log2 n
    rounds. Minima are pre-aggregated on the map side, hence a node with very many neighbours costs
    its join no more than its own rows. Rows with a null end and self loops are ignored.
    """
    e = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = written(contracted(written(e, "cc")), "cc")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .where("u <> v")
            .distinct()
        )
        e = written(small, "cc")
        after = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(after) == before:
            break
        before = tuple(after)
    root = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return root.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(root.select("node"), "node", "left_anti"))
