"""Toxicity by a factorization machine over hashed terms.

Terms are the letter-only words of a text, lower-cased, and their beginnings of five letters, each
hashed into 2 ** ``HASH_BITS`` slots; a text is the set of its slots. From a bounded sample of
labelled documents two kinds of slots are selected: those that differ between the classes by themselves, and of the ``FREQUENT`` most frequent
slots the pairs whose interaction differs from what both have alone, whether or not either differs by itself. The
machine (bias, weight and ``FACTORS`` factors per selected slot) is fitted on them by Adam. The
factors carry pairwise interactions, so that two terms can count together what neither does alone.

Defined results: null, empty and letterless texts get the score of the bias alone. Very long texts are taken whole, as the
set of their slots. Slots that differ equally are taken by number. Rows that repeat a doc_id are scored each for itself. If neither a slot nor a pair
stands out, every score is the share of label 1 in the sample. Without labelled documents of
both classes every score is 0. An empty table gives no rows; columns besides doc_id and text
(labels: doc_id, toxic) are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import free_name, held_out, labelled_sample

#: Documents per class that the machine is fitted on, at most; slots selected, at most.
PER_CLASS, SELECTED = 2500, 1536
#: A slot's difference between the classes in standard errors, and a pair's interaction, at least.
DIFFERENCE, INTERACTION = 4.0, 6.5
#: Slots whose pairs are tested, at most, and documents that each of a pair's four cells has, at least.
FREQUENT, CELL = 2048, 20
HASH_BITS, FACTORS, EPOCHS = 20, 4, 120
WORD = re.compile(r"[^\W\d_]+")


def slots(text: str | None) -> set[int]:
    """Hashed terms of a text."""
    mask = (1 << HASH_BITS) - 1
    words = set(WORD.findall((text or "").lower()))
    out = {zlib.crc32(w.encode()) & mask for w in words}
    return out | {zlib.crc32(b"^" + w.encode()) & mask for w in {w[:5] for w in words if len(w) > 5}}


@dataclass
class Machine:
    """place: slot to row number; table: weight and factors by row, a row of zeros last."""

    place: dict
    bias: float
    table: object

    def scores(self, texts):
        """Probabilities of label 1, from the sums over the terms of all texts together."""
        import numpy as np

        if not self.place:
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)) if np.isfinite(self.bias) else 0.0)
        get, rows, owner = self.place.get, [], []
        for k, text in enumerate(texts):
            own = [r for r in map(get, slots(text)) if r is not None]
            rows += own
            owner += [k] * len(own)
        found, owner = self.table[rows].astype(np.float64), np.array(owner, np.int64)
        total = np.stack([np.bincount(owner, found[:, c], len(texts)) for c in range(found.shape[1])], 1)
        square = np.bincount(owner, (found[:, 1:] ** 2).sum(1), len(texts))
        logit = self.bias + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(1) - square)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(x, y, epochs: int = EPOCHS, factors: int = FACTORS, l2: float = 1e-4, rate: float = 0.03, seed: int = 7):
    """Bias and (weight, factors) of a machine on a 0/1 matrix by full-batch Adam."""
    import numpy as np

    rng = np.random.default_rng(seed)
    table = np.concatenate([np.zeros((x.shape[1], 1)), rng.normal(0, 0.02, (x.shape[1], factors))], 1).astype(np.float32)
    rate_y, bias = float(y.mean()), 0.0
    weight = np.where(y > 0, 0.5 / max(rate_y, 1e-6), 0.5 / max(1 - rate_y, 1e-6)).astype(np.float32)
    m, v, mb, vb = np.zeros_like(table), np.zeros_like(table), 0.0, 0.0
    for step in range(1, epochs + 1):
        total = x @ table
        square = x @ (table[:, 1:] ** 2).sum(1)
        logit = bias + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(1) - square)
        err = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        grad = np.empty_like(table)
        grad[:, 0] = x.T @ err
        grad[:, 1:] = x.T @ (err[:, None] * total[:, 1:]) - (x.T @ err)[:, None] * table[:, 1:]
        grad += l2 * table
        gb = float(err.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        table -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        bias -= rate * (mb / fix1) / (vb / fix2) ** 0.5 if vb else 0.0
    return bias, table


def interacting(x, y, most: int, least: float = INTERACTION, cell: int = CELL) -> list[int]:
    """Columns of the 0/1 matrix ``x`` in pairs whose interaction is ``least`` standard errors or more, strongest first, ``most`` at most.

    The interaction of a pair is the share of label 1 with both, less that with either alone, plus that with neither.
    """
    import numpy as np

    n, p = len(y), float(y.mean())
    both, ones = x.T @ x, x.T @ (x * y[:, None])
    each, own = x.sum(0), x.T @ y
    count = [both, each[:, None] - both, each[None, :] - both, n - each[:, None] - each[None, :] + both]
    label = [ones, own[:, None] - ones, own[None, :] - ones, float(y.sum()) - own[:, None] - own[None, :] + ones]
    error, effect = np.zeros_like(both), np.zeros_like(both)
    for sign, c, k in zip((1, -1, -1, 1), count, label, strict=True):
        effect += sign * k / np.maximum(c, 1)
        error += 1 / np.maximum(c, 1)
    z = np.abs(effect) / np.sqrt(max(p * (1 - p), 1e-9) * error)
    z[np.minimum.reduce(count) < cell] = 0
    strongest = np.triu(z, 1).max(initial=0, axis=1)
    strongest = np.maximum(strongest, np.triu(z, 1).max(initial=0, axis=0))
    order = np.argsort(-strongest, kind="stable")
    return [int(k) for k in order[:most] if strongest[k] >= least]


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, selected: int = SELECTED) -> Machine:
    """Fit on at most ``per_class`` documents of each class that are not held out.

    To the driver come at most ``selected`` + ``FREQUENT`` slots and, per sampled document, its slots among them.
    """
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"doc": batch["doc_id"].astype(str), "y": batch["y"], "slots": [list(slots(t)) for t in batch["text"]]})

    from cinderlake.session import written

    sample = written(labelled_sample(documents, labels, "toxic", per_class).mapInPandas(run, "doc string, y int, slots array<int>"), "toxic-sample")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Machine({}, -np.inf, None)
    seen = sample.select("y", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a + b >= 5")
    p, q = F.col("a") / n[1], F.col("b") / n[0]
    both = (F.col("a") + F.col("b")) / (n[0] + n[1])
    z = F.abs(p - q) / F.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]) + F.lit(1e-9))
    seen = written(seen.select("slot", z.alias("z"), F.least(F.col("a") + F.col("b"), n[0] + n[1] - F.col("a") - F.col("b")).alias("both")), "toxic-slots")
    best = [r["slot"] for r in seen.where(F.col("z") >= DIFFERENCE).orderBy(F.desc("z"), "slot").limit(selected).select("slot").collect()]
    often = [r["slot"] for r in seen.where(F.col("both") >= 2 * CELL).orderBy(F.desc("both"), "slot").limit(FREQUENT).select("slot").collect()]
    wanted = list(dict.fromkeys(best + often))
    known = sample.sparkSession.createDataFrame([(s,) for s in wanted], "slot int")
    cut = sample.select("doc", "y", F.explode("slots").alias("slot")).join(F.broadcast(known), "slot").groupBy("doc", "y").agg(F.collect_list("slot").alias("slots"))
    rows = sample.select("doc", "y").distinct().join(cut, ["doc", "y"], "left").orderBy("doc", "y").collect()
    y, place = np.array([r["y"] for r in rows], np.float32), {s: i for i, s in enumerate(wanted)}
    x = np.zeros((len(rows), len(wanted)), np.float32)
    for i, r in enumerate(rows):
        x[i, [place[s] for s in r["slots"] or ()]] = 1
    pairs = [often[k] for k in interacting(x[:, [place[s] for s in often]], y, selected)]
    chosen = list(dict.fromkeys(best + pairs))
    if not chosen:
        return Machine({}, float(np.log(n[1] / n[0])), None)
    bias, table = train(x[:, [place[s] for s in chosen]], y)
    return Machine({s: i for i, s in enumerate(chosen)}, bias, table)


def score_column(machine: Machine, text: Column) -> Column:
    """The score as a column; other columns of the row don't pass through Python."""

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.scores(texts), dtype="float64")

    return F.pandas_udf(score, "double")(text)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, str]:
    """``documents`` with one more column, a struct of score and predicted, and its name.

    The name is ``toxicity``, with underscores appended while ``documents`` has such a column.
    """
    name = free_name(documents, "toxicity")
    score = score_column(fit(documents, labels), F.col("text").cast("string"))
    scored = documents.withColumn(name, F.struct(score.alias("score")))
    return scored.withColumn(name, F.struct(F.col(f"{name}.score"), (F.col(f"{name}.score") >= threshold).cast("int").alias("predicted"))), name


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that aren't predicted to be toxic, all columns as they are."""
    scored, name = toxicity(documents, labels, threshold)
    return scored.where(F.col(f"{name}.predicted") == 0).select(*[F.col(f"`{c}`") for c in documents.columns])


def op9_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    out, _ = toxicity(documents.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "toxicity.score", "toxicity.predicted")
