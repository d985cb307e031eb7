"""Embedding whitening from exact covariances by polarisation.

Entries become whole numbers (``floor(64 * c) + OFFSET``), so all sums are exact. For every dimension and every sum of two
dimensions the squares of the centred values are added up; ``(var(a + b) - var(a) - var(b)) / 2`` is the
covariance of a and b. Only sums leave the tasks, never a matrix of vectors; the covariance matrix, of the size of the
dimensions squared, is put together on the driver, where its eigenvectors are taken.

1. Vectors are packed in as few bytes per entry as they need, copies collapse on the map side, and each distinct vector is written once.
2. First pass over those: their number and the sum of each dimension.
3. Second pass: values are centred by the mean rounded to a whole number, then squared; the rest of the mean
   is taken off the sums in whole numbers. Sums go out in limbs of 32 bits, so they can't overflow.
4. Third pass: the covariance of the whitened vectors, centred by their own mean, against the identity.
5. Every remaining row is projected.

Defined results: rows whose vector is null, empty or of another length than most distinct vectors have (of equal frequency the
longer), or has an entry that is null, not finite or beyond 2 ** 52 / 64, are dropped. Copies are rows of their own in the
result. Components whose eigenvalue is zero to rounding aren't returned, so a single distinct vector gives no rows; of equal eigenvalues any
eigenvectors are taken. ``deviation`` is null where it exceeds 64 bits. A null vec_id is kept. An empty table gives no rows.
Columns besides vec_id and embedding are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.session import written

OFFSET, SCALE, COMPONENTS = 1_000_000, 64, 16
#: Vectors that a task squares at once.
ROWS_AT_ONCE = 1024
KINDS = {1: "int8", 2: "int16", 4: "int32", 8: "int64"}


def pack(entries) -> bytes | None:
    """A vector of doubles as bytes: width of an entry, then ``floor(SCALE * c)``; None if it is dropped."""
    import numpy as np

    if entries is None or not len(entries):
        return None
    c = np.asarray([np.nan if e is None else e for e in entries] if isinstance(entries, list) else entries, np.float64)
    if not np.isfinite(c).all() or (np.abs(c) > 2.0**52 / SCALE).any():
        return None
    x = np.floor(SCALE * c).astype(np.int64)
    low, high = int(x.min()), int(x.max())
    width = next(w for w in KINDS if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + x.astype(KINDS[width]).tobytes()


def unpack(codes: list[bytes]):
    """``floor(SCALE * c)`` of several vectors of one length, one row each."""
    import numpy as np

    return np.stack([np.frombuffer(c, KINDS[c[0]], offset=1).astype(np.int64) for c in codes]) if codes else np.empty((0, 0), np.int64)


def packed(embeddings: DataFrame) -> DataFrame:
    """``vec_id, code, length`` of the rows that aren't dropped for an entry."""
    kind = embeddings.schema["vec_id"].dataType

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            begins = np.asarray(vectors.offsets)
            flat, whole = np.asarray(vectors.values.to_numpy(zero_copy_only=False), np.float64), vectors.values.is_valid().to_numpy(zero_copy_only=False)
            flat = np.where(whole, flat, np.nan)
            there = vectors.is_valid().to_numpy(zero_copy_only=False)
            codes = [pack(flat[a:b]) if ok else None for a, b, ok in zip(begins[:-1].tolist(), begins[1:].tolist(), there.tolist(), strict=True)]
            keep = pa.array([c is not None for c in codes])
            length = pa.array([0 if c is None else (len(c) - 1) // c[0] for c in codes], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array(codes, pa.binary()), length], ["vec_id", "code", "length"]).filter(keep)

    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"vec_id {kind.simpleString()}, code binary, length int")


def _limbs(value: int) -> list[int]:
    """A whole number in limbs of 32 bits, the last with the sign."""
    return [value & 0xFFFFFFFF, value >> 32 & 0xFFFFFFFF, value >> 64 & 0xFFFFFFFF, value >> 96]


def _exact(matrix) -> list[int]:
    """Sum of each row in Python's whole numbers, whatever the size."""
    bound = max(abs(int(matrix.min())), abs(int(matrix.max()))) if matrix.size else 0
    return [int(v) for v in (matrix.sum(1) if bound * max(matrix.shape[1], 1) < 1 << 62 else matrix.astype(object).sum(1))]


def pair_squares(centred, total: dict) -> None:
    """Add to ``total`` the sums of squares of each row of ``centred`` and of each sum of two rows, exactly."""
    import numpy as np

    bound = 4 * max(abs(int(centred.min())), abs(int(centred.max()))) ** 2 * centred.shape[1]
    y = centred.astype(np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object)
    for i in range(len(y)):
        both = y[i:] + y[i]
        both[0] = y[i]
        own = np.einsum("ij,ij->i", both, both) if y.dtype != object else (both * both).sum(1)
        for j, v in enumerate(own.tolist(), i):
            total[i, j] = total.get((i, j), 0) + int(v)


def _totals(codes: DataFrame, work) -> dict[tuple[int, int], int]:
    """Sums over all vectors: ``work(matrix with a column per vector, total by (i, j))`` adds up those of a few.

    A task sends one row per sum, and the driver gets one row per sum of the whole.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                work(unpack(batch.column(0).slice(at, ROWS_AT_ONCE).to_pylist()).T, total)
        rows = [(i, j, *_limbs(v)) for (i, j), v in total.items()]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", "l0", "l1", "l2", "l3"])

    sums = codes.select("code").mapInArrow(run, "i long, j long, l0 long, l1 long, l2 long, l3 long").groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(4)])
    return {(r["i"], r["j"]): sum(r[f"l{k}"] << 32 * k for k in range(4)) for r in sums.collect()}


@dataclass
class Whitening:
    """n: distinct vectors; sums: of each dimension of x; values, vectors: eigenvalues in falling order and eigenvectors as columns."""

    n: int
    sums: list
    trace: float
    values: object
    vectors: object

    def project(self, floors):
        """Whitened rows for rows of ``floor(SCALE * c)``; centred before anything is multiplied."""
        import numpy as np

        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        centred = (floors - np.array([w - OFFSET for w in whole], np.int64)).astype(np.float64) - rest
        return centred @ self.vectors / np.sqrt(self.values)

    def deviations(self, floors) -> list[int | None]:
        """Sum over the dimensions of ``(n * x - sum) ** 2``, exactly; None beyond 64 bits."""
        import numpy as np

        shift = [s - self.n * OFFSET for s in self.sums]
        bound = self.n * int(np.abs(floors).max(initial=0)) + max(map(abs, shift), default=0)
        kind = np.int64 if bound**2 * max(len(shift), 1) < 1 << 63 else object
        d = self.n * floors.astype(kind) - np.array(shift, kind)
        return [int(v) if int(v) < 1 << 63 else None for v in (d * d).sum(1)]


def fit(codes: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of distinct vectors of one length (``code``); None without vectors."""
    import numpy as np

    def add(x, total: dict) -> None:
        for i, v in enumerate(_exact(x)):
            total[i, i] = total.get((i, i), 0) + v
        total[-1, -1] = total.get((-1, -1), 0) + x.shape[1]

    sums = _totals(codes, add)
    n = sums.pop((-1, -1), 0)
    if not n:
        return None
    floors = [sums[i, i] for i in range(len(sums))]
    centre = [(2 * s + n) // (2 * n) for s in floors]
    left = [s - n * c for s, c in zip(floors, centre, strict=True)]

    def squares(x, total: dict) -> None:
        pair_squares(x - np.array(centre, np.int64)[:, None], total)

    got = _totals(codes, squares)
    dims = range(len(floors))
    # n ** 3 times the variance of each dimension and of each sum of two, in whole numbers
    own = [n * (n * got[i, i] - left[i] ** 2) for i in dims]
    cov = np.empty((len(floors), len(floors)))
    for i in dims:
        cov[i, i] = own[i] / n**3
        for j in range(i + 1, len(floors)):
            cov[i, j] = cov[j, i] = (n * (n * got[i, j] - (left[i] + left[j]) ** 2) - own[i] - own[j]) / (2 * n**3)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0) * len(floors) * np.finfo(float).eps]
    return Whitening(n, [s + n * OFFSET for s in floors], float(np.trace(cov)), values[order], vectors[:, order])


def identity_error(codes: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity.

    Batches send their sums and products by position, which meet in Spark.
    """
    import numpy as np

    size = len(model.values)

    def moments(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            w = model.project(unpack(batch["code"].tolist()))
            mean = w.mean(0)
            yield pd.DataFrame({"n": [len(w)], "total": [(mean * len(w)).tolist()], "products": [((w - mean).T @ (w - mean) + len(w) * np.outer(mean, mean)).ravel().tolist()]})

    # the mean of whitened vectors is zero to rounding, so products about zero lose nothing
    parts = codes.select("code").mapInPandas(moments, "n long, total array<double>, products array<double>")
    each = lambda column: parts.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    both = each("total").select(F.lit(0).alias("part"), "k", "v").union(each("products").select(F.lit(1), "k", "v")).collect()
    total, products = np.zeros(size), np.zeros(size * size)
    for r in both:
        (products if r["part"] else total)[r["k"]] = r["v"]
    mean = total / model.n
    return float(np.abs(products.reshape(size, size) / model.n - np.outer(mean, mean) - np.eye(size)).max(initial=0.0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per remaining row and component."""
    rows = packed(embeddings)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = written(rows.groupBy("code", "length").agg(F.count(F.lit(1)).alias("rows")).select("code", "length"), "whitening-distinct")
    common = distinct.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    model = fit(distinct.where(F.col("length") == common["length"]), components) if common else None
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    codes, length = distinct.where(F.col("length") == common["length"]), common["length"]
    error, explained = identity_error(codes, model), (model.values / model.trace).tolist()

    def project(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        size = len(model.values)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                floors = unpack(part.column(1).to_pylist())
                m = len(floors)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), size))),
                        pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * size, model.n, np.int64)),
                        pa.array([d for d in model.deviations(floors) for _ in range(size)], pa.int64()),
                        pa.array(model.project(floors).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * size, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.where(F.col("length") == length).select("vec_id", "code").mapInArrow(project, schema)


def op13_whitening(embeddings: DataFrame) -> DataFrame:
    """The contract's columns."""
    return whiten(embeddings)
