"""Documents dealt once into chunks, and a packed exchange between chunks and key ranges.

Operators that compare places all over the corpus would have to move the texts to every step that
needs them. Instead the documents are written once as chunks of about two megabytes of
text, compressed, in one file per bucket of chunk ids; buckets grow in number with the corpus, not in size. A step reads the chunks where they are, sends out keys of
places in packed rows, one per chunk and key range, and gets back an answer per row: only keys
and answers are shuffled. A key that a chunk has many times is sent once, so frequent keys are
pre-aggregated. Key ranges grow in number with the corpus, not in size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.session import shared_folder, written

#: Bytes of text of a chunk, and of a bucket of chunks in the mean.
CHUNK_BYTES, BUCKET_BYTES = 2_000_000, 64_000_000
CHUNK_SCHEMA = "chunk long, ids array<long>, ends array<long>, words long, body binary"


def make_chunks(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``chunk, ids, ends, words, body``: documents in the order of their ids within a chunk.

    ``ends`` are the ends of the texts in the joined bytes; ``body`` is those bytes compressed. A
    null text counts as empty. The chunk id has the number of the writing task and a counter;
    files are committed once, so another attempt of a task leaves no second copy.
    """

    def deal(batches: Iterator) -> Iterator:
        import zstandard
        from pyspark import TaskContext

        packer, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        held: list = []
        size = 0

        def close() -> pd.DataFrame:
            nonlocal held, size, number
            held.sort(key=lambda x: (x[0] is not None, x[0] or 0))
            body = b"".join([t for _, t in held])
            out = pd.DataFrame({
                "chunk": [number], "ids": [[i for i, _ in held]], "ends": [np.cumsum([len(t) for _, t in held]).tolist()],
                "words": [body.count(b" ") + len(held)], "body": [packer.compress(body)],
            })
            held, size, number = [], 0, number + 1
            return out

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                held.append((None if pd.isna(doc) else int(doc), data))
                size += len(data) + 64
                if size >= chunk_bytes:
                    yield close()
        if held:
            yield close()

    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.mapInPandas(deal, CHUNK_SCHEMA)
    name, path = f"chunks_{uuid.uuid4().hex}", shared_folder(spark, "chunks")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    dealt.repartition(buckets, "chunk").write.option("path", path).bucketBy(buckets, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    chunks.schema  # resolves the table while its name exists; the files stay
    spark.sql(f"DROP TABLE {name}")
    return chunks


class Chunk:
    """The texts of one chunk."""

    def __init__(self, row):
        import zstandard

        self.id = int(row["chunk"])
        self.body = zstandard.ZstdDecompressor().decompress(row["body"]) if len(row["ends"]) else b""
        self.ends = np.asarray(row["ends"], np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.ids = [None if pd.isna(i) else int(i) for i in row["ids"]]
        self.data = np.frombuffer(self.body, np.uint8)

    def texts(self) -> Iterator[tuple]:
        """doc_id, begin, end of each document."""
        return zip(self.ids, self.begins.tolist(), self.ends.tolist())


def ranges(high, parts: int):
    """Number of the key range of each 64-bit key."""
    return ((high >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cuts(sorted_ranges, parts: int):
    """For ascending range numbers: those that occur, with begin and end."""
    own = np.unique(sorted_ranges)
    return zip(own.tolist(), np.searchsorted(sorted_ranges, own).tolist(), np.searchsorted(sorted_ranges, own, "right").tolist())


def over_chunks(chunks: DataFrame, work: Callable[[Chunk, dict], Iterator[pd.DataFrame]], schema: str, answers: DataFrame | None = None) -> DataFrame:
    """Rows that ``work(chunk, answers by range)`` makes of each chunk. Chunks don't move."""
    rows = chunks
    if answers is not None:
        got = answers.groupBy(F.col("chunk").alias("_c")).agg(F.collect_list(F.struct("range", "answer")).alias("got"))
        rows = chunks.join(got, F.col("chunk") == F.col("_c"), "left").drop("_c")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for _, row in batch.iterrows():
                got = row.get("got")
                yield from work(Chunk(row), {int(g["range"]): g["answer"] for g in got} if got is not None else {})

    return rows.mapInPandas(run, schema)


def by_range(sent: DataFrame, answer: Callable[[pd.DataFrame], list[bytes]], label: str) -> DataFrame:
    """``chunk, range, answer``: one answer for each row sent, from all rows of its range."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        return pd.DataFrame({"chunk": rows["chunk"], "range": rows["range"], "answer": answer(rows)})

    out = sent.groupBy("range").applyInPandas(run, "chunk long, range long, answer binary")
    return written(out, label)


def join_arrays(column, kind) -> tuple:
    """All packed arrays of a column as one, and the sizes of its parts."""
    parts = [np.frombuffer(x, kind) for x in column]
    return np.concatenate(parts), np.array([len(p) for p in parts])
