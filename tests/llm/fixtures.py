"""Awkward little corpora."""

from __future__ import annotations

import random


def corpus(seed: int = 1, n: int = 40, words: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, loops, nulls, blanks and long texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "straße", "ñu", "x,", "Ab"]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage, long_passage = text(35), text(160)
    out: list = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "loop " * 300), (5, text(words)), (5, text(words))]
    out += [(6, text(words)), (None, text(20))]
    out.append((6, out[-2][1]))
    for i in range(10, 10 + n):
        kind = rnd.randrange(6)
        base = text(rnd.randrange(1, words))
        if kind == 0:
            base = out[rnd.randrange(5, len(out))][1] or ""
        elif kind == 1:
            base = text(5) + " " + passage + "\n" + text(rnd.randrange(4))
        elif kind == 2:
            base = text(3) + " " + long_passage + " " + text(4)
        elif kind == 3:
            own = (out[rnd.randrange(5, len(out))][1] or "x").split(" ")
            own[rnd.randrange(len(own))] = "changed"
            base = " ".join(own)
        elif kind == 4:
            base = base.upper()
        out.append((i, base))
    out.append((10 + n, text(4000)))
    return out


def frame(spark, rows, extra: bool = True):
    """A DataFrame with columns whose names clash with those used inside."""
    rows = [(i, t, "en", "s", 1, 2.0, "q") for i, t in rows]
    kind = "doc_id long, text string, lang string, source string, chunk int, score double, key string"
    df = spark.createDataFrame(rows, kind).repartition(3)
    return df if extra else df.select("doc_id", "text")
