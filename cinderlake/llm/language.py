"""Language by cross-parsing entropy.

A suffix automaton is built of a bounded sample of labelled text per language, of all languages that are
labelled. A text is parsed against each automaton from left to right into phrases, each the longest match
that starts there, or one byte that the sample doesn't have; the language that needs fewest phrases,
normalised by the logarithm of its sample's length, wins.

Before parsing, letters are lower-cased and all ASCII bytes but letters become one blank. All texts
of a batch are parsed together, whole: they are cut into stretches of ``STRETCH`` bytes, which advance a byte a
step as if a phrase began with each of them. Then the phrase that really runs into a stretch is followed until a phrase begins
where one had begun before; from there on both parsings are the same. So phrases run on over the ends of stretches.

An automaton takes about a megabyte, and the tasks get those of all languages: their memory grows with the number of
different labels, and with nothing else.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if no
language was learned. Ties go to the language whose name is first. Rows that repeat a doc_id are
predicted each for itself. An empty table gives no rows; very long texts are parsed whole; besides doc_id and text, and
lang when learning, columns are not looked at, and none is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import bounded, free_name, held_out
from cinderlake.session import written

#: Bytes of sample text per language at most, and different texts that they are pieces of.
SAMPLE_BYTES, SAMPLE_TEXTS = 24_000, 100
STRETCH = 512
#: Stretches whose parsing is remembered at a time.
KEPT = 20_000
LETTER = re.compile(r"[^\W\d_]")


def normal_bytes(text: str):
    """Lower-case UTF-8 as an array; each run of non-letters in ASCII is one blank."""
    import numpy as np

    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = np.arange(97, 123)
    data = table[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    return data[keep]


def suffix_automaton(data: bytes) -> list[dict]:
    """Transitions of the suffix automaton of ``data``; state 0 is the start."""
    moves: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


@dataclass
class Automaton:
    """A language's automaton as one array: state s goes by byte c to ``target[base[s] + c]`` if ``owner`` there is s.

    State 0 has no way on; ``first`` is the state after one byte, 0 for a byte that the sample doesn't have.
    """

    name: str
    size: int
    base: object
    owner: object
    target: object
    first: object

    @classmethod
    def build(cls, name: str, data: bytes):
        """From sample text: states with several ways are fitted between each other, the others fill the gaps."""
        import numpy as np

        moves = suffix_automaton(data)
        total = sum(map(len, moves)) + 512
        taken, base = bytearray(8 * total + 1024), [0] * (len(moves) + 1)
        gap, begin = 256, [256] * 257  # states with as many ways are tried from where the last one of them fitted
        for state in sorted((s for s in range(len(moves)) if len(moves[s]) > 1), key=lambda s: -len(moves[s])):
            ways = list(moves[state])
            low, at = min(ways), max(gap, begin[len(ways)])
            while taken[at] or any(taken[at - low + c] for c in ways):
                at += 1
            base[state + 1], begin[len(ways)] = at - low, at
            for c in ways:
                taken[at - low + c] = 1
            while taken[gap]:
                gap += 1
        for state, ways in enumerate(moves):
            if len(ways) == 1:
                while taken[gap]:
                    gap += 1
                taken[gap] = 1
                base[state + 1] = gap - next(iter(ways))
        size = max(base) + 257
        owner, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        for state, ways in enumerate(moves):
            for c, to in ways.items():
                owner[base[state + 1] + c], target[base[state + 1] + c] = state + 1, to + 1
        first = np.zeros(256, np.int32)
        for c, to in moves[0].items():
            first[c] = to + 1
        return cls(name, len(data), np.array(base, np.int32), owner, target, first)

    def step(self, state, c):
        """States after a byte each, and where the phrase went on."""
        import numpy as np

        at = self.base[state] + c
        on = self.owner[at] == state
        return np.where(on, self.target[at], self.first[c]), on

    def phrases(self, grid, length, follows, number):
        """True number of phrases that begin in each stretch.

        ``grid`` has a stretch per column, shorter ones last; ``follows`` is the column that precedes each in its text, or -1. ``number`` counts the stretches through all texts.
        """
        import numpy as np

        steps, columns = grid.shape
        active = np.searchsorted(-length, -np.arange(steps), side="left")
        begins = np.zeros((steps, columns), bool)
        begins[0] = True
        state = self.first[grid[0]]
        for t in range(1, steps):
            n = active[t]
            if not n:
                break
            state[:n], on = self.step(state[:n], grid[t, :n])
            begins[t, :n] = ~on
        upto = np.cumsum(begins, axis=0, dtype=np.uint16)
        count, lost = upto[-1].astype(np.int32), []
        own = np.flatnonzero(follows >= 0)
        now, more = state[follows[own]], np.zeros(len(own), np.int32)
        for t in range(steps):
            ended = length[own] <= t
            for column, extra, s in zip(own[ended].tolist(), more[ended].tolist(), now[ended].tolist()):
                count[column] = extra
                lost.append((column, s))
            own, now, more = own[~ended], now[~ended], more[~ended]
            if not len(own):
                break
            now, on = self.step(now, grid[t, own])
            met = ~on & begins[t, own]
            count[own[met]] = more[met] + upto[-1, own[met]] - upto[t, own[met]] + 1
            more += ~on
            own, now, more = own[~met], now[~met], more[~met]
        for column, extra, s in zip(own.tolist(), more.tolist(), now.tolist()):
            count[column] = extra
            lost.append((column, s))
        if lost:
            self._settle(grid, length, follows, begins, upto, count, dict(lost), number)
        return count

    def _settle(self, grid, length, follows, begins, upto, count, end: dict, number) -> None:
        """Parse on after stretches in which the phrases never met those that began with them; ``end`` has their last states.

        Goes forward along the chain of stretches of a text, each once. What a stretch gives depends on its bytes and the state before it only,
        so stretches that repeat (one letter a million times) are looked up: up to ``KEPT`` of them are remembered.
        """
        import numpy as np

        after = np.full(len(follows), -1)
        after[follows[follows >= 0]] = np.flatnonzero(follows >= 0)
        done, seen = bytearray(len(follows)), {}
        for column in sorted(end, key=number.__getitem__):
            state, column = end[column], column if done[column] else int(after[column])
            while column >= 0 and not done[column]:
                done[column] = 1
                body = grid[: length[column], column].tobytes()
                if (known := seen.get((state, body))) is None:
                    if len(seen) >= KEPT:
                        seen.clear()
                    known = seen[state, body] = self._follow(state, body, begins[:, column], upto[:, column])
                count[column], state, met = known
                column = -1 if met else int(after[column])

    def _follow(self, state: int, body: bytes, begins, upto) -> tuple[int, int, bool]:
        """Phrases that begin in a stretch after a state, the state at its end, and whether they met the stretch's own."""
        extra = 0
        for t, c in enumerate(body):
            at = self.base[state] + c
            if self.owner[at] == state:
                state = int(self.target[at])
            elif begins[t]:
                return extra + int(upto[-1] - upto[t]) + 1, state, True
            else:
                extra, state = extra + 1, int(self.first[c])
        return extra, state, False


@dataclass
class Languages:
    """The automata, by name."""

    automata: list

    def phrases(self, texts: list):
        """Phrases per text and language."""
        import numpy as np

        coded = [normal_bytes(t) for t in texts]
        sizes = np.array([len(c) for c in coded])
        stretches = -(-sizes // STRETCH)
        owner, total = np.repeat(np.arange(len(texts)), stretches), int(stretches.sum())
        counts = np.zeros((len(texts), len(self.automata)), np.int64)
        if not total:
            return counts
        flat, at = np.zeros(total * STRETCH, np.uint8), 0
        for c, n in zip(coded, stretches.tolist(), strict=True):
            flat[at : at + len(c)] = c
            at += n * STRETCH
        length = np.full(total, STRETCH)
        length[np.cumsum(stretches)[stretches > 0] - 1] = (sizes - (stretches - 1) * STRETCH)[stretches > 0]
        order = np.argsort(-length, kind="stable")
        place = np.empty(total, np.int64)
        place[order] = np.arange(total)
        before = np.where(np.append(-1, owner[:-1]) == owner, np.arange(total) - 1, -1)[order]
        follows = np.where(before >= 0, place[before], -1)
        grid = np.ascontiguousarray(flat.reshape(total, STRETCH)[order].T)
        for k, automaton in enumerate(self.automata):
            counts[:, k] = np.bincount(owner[order], automaton.phrases(grid, length[order], follows, order), len(texts))
        return counts

    def predict(self, texts: list) -> tuple[list, list]:
        """Names and scores; about 2 MB of text are parsed at a time, one text at least."""
        import numpy as np

        names, scores, a = ["und"] * len(texts), [0.0] * len(texts), 0
        if not self.automata:
            return names, scores
        scale = np.log2([max(x.size, 2) for x in self.automata])
        todo = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        while a < len(todo):
            b, size = a, 0
            while b < len(todo) and (b == a or size < 2_000_000):
                size += len(texts[todo[b]])
                b += 1
            cost = self.phrases([texts[i] for i in todo[a:b]]) * scale
            for i, k, row in zip(todo[a:b], cost.argmin(1), cost, strict=True):
                rest = np.delete(row, k)
                names[i] = self.automata[k].name
                scores[i] = float(rest.min() / (rest.min() + row[k])) if len(rest) and row[k] > 0 else 1.0
            a = b
        return names, scores


def samples(documents: DataFrame, sample_bytes: int, sample_texts: int) -> DataFrame:
    """``lang, slot, piece``: an equal share of ``sample_bytes`` characters of each of at most ``sample_texts`` different texts.

    Texts are dealt by their hash into that many slots, of which each takes the text with the smallest hash: the choice doesn't depend
    on the layout, copies count once, and each task passes on one row per slot and language.
    """
    text = F.col("text").cast("string")
    known = documents.where(F.col("lang").isNotNull() & text.isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("lang").cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("h"))
    known = known.withColumn("slot", F.pmod("h", F.lit(sample_texts)))
    picked = written(known.groupBy("lang", "slot").agg(F.min("h").alias("h")), "language-picked")
    share = picked.groupBy("lang").agg(F.ceil(F.lit(sample_bytes) / F.count(F.lit(1))).cast("int").alias("share"))
    picked = written(picked.join(share, "lang"), "language-shares")
    begin = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - F.col("share"), F.lit(0)) + 1).cast("int") + 1
    pieces = known.join(bounded(picked), ["lang", "slot", "h"]).select("lang", "slot", F.substring("text", begin, F.col("share")).alias("piece"))
    return pieces.groupBy("lang", "slot").agg(F.min("piece").alias("piece"))


def learn(documents: DataFrame, sample_bytes: int = SAMPLE_BYTES, sample_texts: int = SAMPLE_TEXTS) -> Languages:
    """An automaton of ``sample_bytes`` at most for every language, each built in a task."""
    import numpy as np

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        share = (sample_bytes + 1) // len(rows) - 1  # in bytes, beside a blank each: letters may have several
        texts = [normal_bytes(p).tobytes()[: max(share, 1)] for p in rows.sort_values("slot")["piece"]]
        a = Automaton.build(rows["lang"].iloc[0], b" ".join(texts)[:sample_bytes])
        return pd.DataFrame({"name": [a.name], "size": [a.size], "base": [a.base.tobytes()], "owner": [a.owner.tobytes()], "target": [a.target.tobytes()], "first": [a.first.tobytes()]})

    rows = samples(documents, sample_bytes, sample_texts).groupBy("lang").applyInPandas(build, "name string, size long, base binary, owner binary, target binary, first binary")
    return Languages([
        Automaton(r["name"], r["size"], *[np.frombuffer(r[c], np.int32) for c in ("base", "owner", "target", "first")])
        for r in sorted(rows.collect(), key=lambda r: r["name"])
    ])


def predict_columns(languages: Languages, text: Column) -> Column:
    """A struct of lang_pred and score."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(languages)

    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict([None if t is None else str(t) for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return F.pandas_udf(predict, "lang_pred string, score double")(text)


def identify(documents: DataFrame, learn_from: DataFrame) -> tuple[DataFrame, str]:
    """``documents`` with one more column, a struct of lang_pred and score, and its name.

    The name is ``language``, with underscores appended while ``documents`` has such a column.
    """
    name = free_name(documents, "language")
    return documents.withColumn(name, predict_columns(learn(learn_from), F.col("text").cast("string"))), name


def op8_language(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    out, _ = identify(documents.select("doc_id", "text"), documents)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")
