"""Many terms in many texts, by Aho-Corasick automata.

A text is read once however many terms there are. The terms are a table; they are dealt into automata of at most ``most_bytes`` of
text, each built once on the driver and broadcast. One is the common case; where the terms need more, the texts are scanned once per automaton, and
no task ever holds two.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of terms in one automaton (about a hundred times that in memory).
MOST_BYTES = 4_000_000


def _automaton(rows: list) -> bytes:
    """Pickled automaton over the terms; at a term the places of its ids in ``rows``."""
    import pickle

    import ahocorasick

    found: dict[str, list[int]] = {}
    for k, r in enumerate(rows):
        found.setdefault(r["term"], []).append(k)
    machine = ahocorasick.Automaton()
    for term, places in found.items():
        machine.add_word(term, tuple(places))
    machine.make_automaton()
    return pickle.dumps(machine)


def terms_found(rows: DataFrame, row_id: str, text: Column, terms: DataFrame, term_id: str, term: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``term_id, row_id``: which texts have which terms, each pair once per row.

    Equal to ``contains(lower(text), lower(term))``: texts and terms are lower-cased by Spark. Null texts and terms match nothing; an empty term is in
    every text. Rows that repeat an id are searched each for itself.
    """
    spark, kind_t, kind_r = rows.sparkSession, terms.schema[term_id].dataType, rows.schema[row_id].dataType
    low = rows.select(F.col(row_id).alias(row_id), F.lower(text).alias("_text")).where("_text IS NOT NULL")
    known = terms.select(F.col(term_id).alias("id"), F.lower(F.col(term)).alias("term")).where("term IS NOT NULL").distinct()
    size = known.agg(F.sum(F.octet_length("term") + F.lit(16))).first()[0] or 0
    parts = max(1, -(-size // most_bytes))
    schema = f"{term_id} {kind_t.simpleString()}, {row_id} {kind_r.simpleString()}"
    out = None
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).collect()
        if not own:
            continue
        machine = spark.sparkContext.broadcast((_automaton([r for r in own if r["term"]]), [r["id"] for r in own if r["term"]], [r["id"] for r in own if not r["term"]]))

        def search(batches: Iterator, machine=machine) -> Iterator:
            import pickle

            import pyarrow as pa

            packed, ids, always = machine.value
            automaton = pickle.loads(packed)
            for batch in batches:
                whose, which = [], []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    hits = {p for _, places in automaton.iter(t) for p in places} if ids else ()
                    which += [ids[p] for p in hits] + always
                    whose += [k] * (len(hits) + len(always))
                found = batch.column(0).take(pa.array(whose, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(which, pa_type), found], [term_id, row_id])

        from pyspark.sql.pandas.types import to_arrow_type

        pa_type = to_arrow_type(kind_t)
        one = low.mapInArrow(search, schema)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out
