"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes a vector of hashed terms that describe its form: the shape of each word (letters to
``a`` or ``A``, digits to ``0``, equal neighbours squeezed, punctuation as it is) and of each pair of
words, whether a word or line repeats, and how many words differ. Shares of terms, square-rooted and
weighted by rarity, are projected on the leading singular vectors of the labelled sample. The
labelled vectors, bounded by ``PER_CLASS``, are broadcast; every document is compared with all of
them by exact cosine products in blocks, and its nearest ones vote with their similarity as weight.

Defined results: null, empty and blank texts have one term of their own and are scored like any
other. Rows that repeat a doc_id are scored each for itself. Without labelled documents every score is 0.5.
Equal similarities are resolved by the order of the sample; a text unlike all of them is scored by the first. Very long texts
are taken whole. An empty table gives no rows; columns
besides doc_id and text (labels: doc_id, quality) are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import free_name, held_out, labelled_sample

#: Labelled documents per class at most; hashed terms; latent dimensions; neighbours that vote.
PER_CLASS, TERMS, LATENT, NEIGHBOURS = 2000, 512, 40, 25
#: Similarity that a neighbour counts with at least, so that texts unlike all others have a score too.
LEAST = 0.01


def _shapes():
    """Byte to shape byte: bytes over 127 count as small letters."""
    import numpy as np

    table = np.arange(256, dtype=np.uint8)
    table[97:123] = table[128:] = ord("a")
    table[65:91], table[48:58] = ord("A"), ord("0")
    return table


def term_counts(text: str | None, shapes, cache: dict) -> dict[int, float]:
    """Weights by hashed term. The shapes' cache stays small because shapes are few."""
    import numpy as np

    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return {zlib.crc32(b"nothing") % TERMS: 1.0}
    form = shapes[np.frombuffer(data, np.uint8)]
    keep = np.concatenate([[True], form[1:] != form[:-1]])
    found = form[keep].tobytes().split()
    out: Counter = Counter()

    def add(term: bytes, n: float) -> None:
        slot = cache.get(term)
        if slot is None:
            if len(cache) > 200_000:
                cache.clear()
            slot = cache[term] = zlib.crc32(term) % TERMS
        out[slot] += n

    n = len(words)
    for shape, k in Counter(found).items():
        add(b"s" + shape, k / n)
    for (a, b), k in Counter(zip(found, found[1:])).items():
        add(b"p" + a[-1:] + b[:1], k / n)
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    distinct = len(set(words)) / n * max(1.0, n / 400) ** 0.25
    lines = data.split(b"\n")
    for name, share in ((b"again", again), (b"distinct", min(distinct, 1.0)), (b"lines", len(set(lines)) / len(lines))):
        add(b"." + name + b"%d" % round(share * 8), 0.5)
    for level in (4, 16, 64, 256, 1024):
        add(b".more%d" % level, 0.05 if n > level else 0.0)
    return out


@dataclass
class Space:
    """Rarity weights, projection, unit vectors of the sample and their labels."""

    rarity: object
    basis: object
    vectors: object
    labels: object

    def project(self, texts):
        """Unit latent vectors of texts."""
        import numpy as np

        shapes, cache = _shapes(), {}
        x = np.zeros((len(texts), TERMS), np.float32)
        for i, text in enumerate(texts):
            for slot, w in term_counts(text, shapes, cache).items():
                x[i, slot] = w
        z = (np.sqrt(x) * self.rarity) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, texts, block: int = 512):
        """Weighted share of label 1 among the nearest neighbours."""
        import numpy as np

        if self.vectors is None:
            return np.full(len(texts), 0.5)
        out, k = np.empty(len(texts)), min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts), block):
            near = self.project(texts[a : a + block]) @ self.vectors.T
            at = np.argpartition(-near, k - 1, axis=1)[:, :k]
            least = np.take_along_axis(near, at, 1).min(1, keepdims=True)
            for row in np.flatnonzero((near >= least).sum(1) > k):  # ties at the edge: the first of the sample count
                at[row] = np.argsort(-near[row], kind="stable")[:k]
            weight = np.maximum(np.take_along_axis(near, at, 1), LEAST).astype(np.float64) ** 8
            out[a : a + block] = (weight * self.labels[at]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Space:
    """Project at most ``per_class`` labelled documents of each class that are not held out.

    The driver gets their term weights only (TERMS numbers each), not their texts.
    """
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        shapes, cache = _shapes(), {}
        for batch in batches:
            found = [term_counts(t, shapes, cache) for t in batch["text"]]
            yield pd.DataFrame({"doc": batch["doc_id"].astype(str), "y": batch["y"], "slots": [list(f) for f in found], "weights": [[float(w) for w in f.values()] for f in found]})

    sample = labelled_sample(documents, labels, "quality", per_class).mapInPandas(run, "doc string, y int, slots array<int>, weights array<double>")
    rows = sorted(sample.collect(), key=lambda r: r["doc"])
    if not rows:
        return Space(None, None, None, None)
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        x[i, r["slots"]] = r["weights"]
    rarity = np.sqrt(np.log((1 + len(rows)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = np.sqrt(x) * rarity
    value, basis = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = basis[:, np.argsort(-value)[:LATENT]].astype(np.float32)
    z = x @ basis
    return Space(rarity, basis, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9), np.array([r["y"] for r in rows], np.float32))


def score_column(space: Space, text: Column) -> Column:
    """The score as a column."""
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(space.scores(texts.tolist()), dtype="float64")

    return F.pandas_udf(score, "double")(text)


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> tuple[DataFrame, str]:
    """``documents`` with one more column, a struct of score and predicted, and its name.

    The name is ``quality``, with underscores appended while ``documents`` has such a column.
    """
    name = free_name(documents, "quality")
    score = score_column(fit(documents, labels), F.col("text").cast("string"))
    scored = documents.withColumn(name, F.struct(score.alias("score")))
    return scored.withColumn(name, F.struct(F.col(f"{name}.score"), (F.col(f"{name}.score") >= threshold).cast("int").alias("predicted"))), name


def op4_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    out, _ = quality(documents.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "quality.score", "quality.predicted")
