"""Structure of many JSON payloads as rows: a merge that no order or split changes.

``contracts.merge`` folds structures one after another, and where keys differ the order decides. Here every payload gives
rows (path, kind, n), which Spark adds up like any count; keys are kept until all payloads were seen and are
collapsed once, level by level from the root:

* a node of several kinds, empty and null aside, varies, and what lies below it goes;
* an object whose key sets differ (a key was seen less often than the object) and whose children all have one kind is a map:
  its keys become ``*``, and what lies below them is merged;
* a node without any kind is null if a null was seen, else empty.

For two payloads that is what ``contracts.merge`` gives, but for empty beside null. No task holds a group: a map of a million free keys is a million rows.
"""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.operators.contracts import ANY_KEY, DEEP, EMPTY, MOST, NULL, NUMBER, VARIES, diff
from cinderlake.session import written

_NODES = "array<struct<path:array<string>,kind:string,n:long>>"
_KEY, _ITEM = ".", "[]"
#: Payloads of a task, about: free keys make rows of their own, so a task's memory follows them.
TASK_PAYLOADS = 100_000
#: Outcomes of a check.
NO_BASELINE, DRIFT, MATCH = "no-baseline", "drift", "alive+match"


def nodes(value) -> Counter:
    """How often each (path, kind) occurs in a value; a path has ``.key`` and ``[]`` as its steps."""
    out: Counter = Counter()

    def visit(v, path: tuple) -> None:
        below = ()
        if len(path) > MOST:
            kind = DEEP
        elif isinstance(v, dict) and v:
            kind, below = "dict", [(_KEY + k, x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            kind, below = "list", [(_ITEM, x) for x in v]
        elif v is None:
            kind = NULL
        elif isinstance(v, bool):
            kind = "bool"
        elif isinstance(v, int | float):
            kind = NUMBER
        else:
            kind = "str" if v and isinstance(v, str) else EMPTY
        out[path, kind] += 1
        for step, x in below:
            visit(x, (*path, step))

    visit(value, ())
    return out


def node_column(payload: Column) -> Column:
    """``nodes`` of each JSON text; null for texts that can't be read."""

    def one(text):
        try:
            found = nodes(json.loads(text))
        except (TypeError, ValueError):
            return None
        return [{"path": list(p), "kind": k, "n": n} for (p, k), n in found.items()]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(run, _NODES)(payload)


def _kinds(kind: str) -> Column:
    return F.collect_set(F.when(~F.col(kind).isin(EMPTY, NULL), F.col(kind)))


def _collapse(rows: DataFrame, level: int) -> DataFrame:
    """Rows (_key, path, kind, n) with the nodes of a level settled."""
    upto = F.slice("path", 1, level)
    own = rows.where(F.size("path") == level).groupBy("_key", F.col("path").alias("_upto")).agg(_kinds("kind").alias("_own"), F.sum(F.when(F.col("kind") == "dict", F.col("n"))).alias("_dicts"))
    keys = rows.where((F.size("path") == level + 1) & F.element_at("path", -1).startswith(_KEY)).groupBy("_key", "path").agg(_kinds("kind").alias("_k"), F.sum("n").alias("_seen"))
    maps = keys.groupBy("_key", upto.alias("_upto")).agg(F.array_distinct(F.flatten(F.collect_set("_k"))).alias("_below"), F.min("_seen").alias("_least"))
    state = own.join(maps, ["_key", "_upto"], "left").select(
        "_key", "_upto", (F.size("_own") > 1).alias("_varies"), F.coalesce((F.col("_least") < F.col("_dicts")) & (F.size("_below") <= 1), F.lit(False)).alias("_map")
    ).where("_varies OR _map")
    both = rows.withColumn("_upto", F.when(F.size("path") >= level, upto)).join(state, ["_key", "_upto"], "left")
    both = both.where(~(F.coalesce("_varies", F.lit(False)) & (F.size("path") > level)))
    free = F.coalesce("_map", F.lit(False)) & (F.size("path") > level) & F.get("path", F.lit(level)).startswith(_KEY)
    path = F.when(free, F.concat(upto, F.array(F.lit(_KEY + ANY_KEY)), F.slice("path", level + 2, MOST + 2))).otherwise(F.col("path"))
    kind = F.when(F.coalesce("_varies", F.lit(False)), VARIES).otherwise(F.col("kind"))
    return both.select("_key", path.alias("path"), kind.alias("kind"), "n").groupBy("_key", "path", "kind").agg(F.sum("n").alias("n"))


def shape_rows(rows: DataFrame, by: list[str], payload: str) -> DataFrame:
    """``by, path, kind, n``: nodes of the merged structure per ``by``, path as an array, and how often each was seen.

    Texts that can't be read, and null, give nothing. Null in ``by`` is a group as any other. One written table per level, nine at most.
    Payloads are dealt evenly before they are taken apart, more of them to more tasks, since a file's part may hold millions.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_PAYLOADS))
    found = rows.select(*dict.fromkeys([*by, payload])).repartition(tasks).select(F.struct(*by).alias("_key"), F.explode(node_column(F.col(payload).cast("string"))).alias("_x")).select("_key", "_x.*")
    out = written(found.groupBy("_key", "path", "kind").agg(F.sum("n").alias("n")), "shape")
    deepest = out.agg(F.max(F.size("path"))).first()[0]
    for level in range(-1 if deepest is None else deepest + 1):
        out = written(_collapse(out, level), "shape")
    merged = out.groupBy("_key", "path").agg(_kinds("kind").alias("_k"), F.max((F.col("kind") == NULL).cast("int")).alias("_null"), F.sum("n").alias("n"))
    kind = F.coalesce(F.get("_k", F.lit(0)), F.when(F.col("_null") == 1, NULL).otherwise(EMPTY))
    return merged.select(*[F.col("_key")[b].alias(b) for b in by], "path", kind.alias("kind"), "n")


def path_text(path: Column) -> Column:
    """A path as text, from ``$``; the root alone is ``$``."""
    return F.concat(F.lit("$"), F.array_join(path, ""))


def _tree(all_of: list) -> str:
    kinds = {tuple(x["path"]): x["kind"] for x in all_of}
    below: dict = {}
    for p in kinds:
        if p:
            below.setdefault(p[:-1], []).append(p)

    def build(p: tuple):
        if kinds[p] == "dict":
            return {c[-1][len(_KEY) :]: build(c) for c in sorted(below.get(p, ()))}
        if kinds[p] == "list":
            return [build(c) for c in below.get(p, ())]
        return kinds[p]

    return json.dumps(build(()), sort_keys=True)


def shape_texts(shapes: DataFrame, by: list[str]) -> DataFrame:
    """``by, structure, n``: each merged structure as one JSON text, which is what one row here holds, and how many payloads it has."""

    def run(all_of: pd.Series) -> pd.Series:
        return all_of.map(_tree)

    held = shapes.groupBy(*by).agg(F.collect_list(F.struct("path", "kind")).alias("_all"), F.max(F.when(F.size("path") == 0, F.col("n"))).alias("n"))
    return held.select(*by, F.pandas_udf(run, "string")("_all").alias("structure"), "n")


def check(samples: DataFrame, baseline: DataFrame, name: str, structure: str) -> DataFrame:
    """``name, status, problems``: structures of samples against the stored ones of their names; problems as ``path what``, in order."""
    known = baseline.select(F.col(name), F.col(structure).alias("_old"))

    def run(olds: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else sorted(f"{p} {w}" for p, w in diff(json.loads(o), json.loads(s))) for o, s in zip(olds, news)])

    found = samples.join(known, name, "left").select(name, F.pandas_udf(run, "array<string>")("_old", structure).alias("problems"))
    status = F.when(F.col("problems").isNull(), NO_BASELINE).when(F.size("problems") > 0, DRIFT).otherwise(MATCH)
    return found.select(name, status.alias("status"), F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))
