"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and calls one operator of ``cinderlake.llm``; all but the last return
the columns of documents, for the rows that stay. ``run`` writes every stage's result to the shared folder and
reads it back for the next. SQL can't express the stages (a trained model, fingerprints, token ids), so
ORACLE_SQL is None and the tests hold each stage against a plain version.

Defined results: rows with a null or empty text are not toxic, one of them stays after exact
deduplication, and it is packed as one closing id. Rows without a doc_id are kept or dropped like any other. Columns
of any name pass through unchanged, those included that an operator uses for its own results. Of equal texts the largest doc_id stays, of
near copies the smallest. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderlake.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from cinderlake.session import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorization machine doesn't predict to be toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash finds and five-word shingles confirm."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length."""
    return packing.op3_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
