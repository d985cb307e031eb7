import math
import random
from fractions import Fraction

import numpy as np
import pytest

from cinderlake.llm import whitening


def vectors(n=200, dims=20, seed=5):
    rnd = random.Random(seed)
    mix = [[rnd.gauss(0, 1) * 2.0 ** (-k / 4) for _ in range(dims)] for k in range(dims)]
    out = [[sum(a * b for a, b in zip(z, column, strict=True)) for column in zip(*mix, strict=True)] for z in ([rnd.gauss(0, 1) for _ in range(dims)] for _ in range(n))]
    return [(k, v) for k, v in enumerate(out)]


def rows():
    good = vectors()
    dims = len(good[0][1])
    copies = [(1000 + k, good[k % 3][1]) for k in range(90)] + [(7, good[8][1]), (None, good[9][1])]
    bad = [(2000, None), (2001, []), (2002, [math.nan] * dims), (2003, [math.inf] + [0.0] * (dims - 1)), (2004, [None] + [0.0] * (dims - 1)), (2005, [1.0] * (dims + 1)), (2006, [1e30] * dims)]
    return good + copies, bad


def frame(spark, data, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2.0, "c") for i, v in data], f"vec_id long, embedding array<{kind}>, n int, whitened double, code string").repartition(4)


def test_against_whole_matrix(spark):
    good, bad = rows()
    got = whitening.op13_whitening(frame(spark, good + bad, "double")).collect()
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    cov = np.cov(fit.T, bias=True)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:16], basis[:, ::-1][:, :16]
    assert len(got) == 16 * len(good) and {r["n"] for r in got} == {n}
    by: dict = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    for k, (i, _) in enumerate(good):
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], s, strict=True))
        own = by[i, deviation]
        want = (x[k] - s / n) @ basis / np.sqrt(values)
        assert sorted(own) == list(range(1, 17))
        assert np.allclose(np.abs([own[c]["whitened"] for c in sorted(own)]), np.abs(want), rtol=1e-6, atol=1e-8)
    first = {r["component"]: r for r in got}
    assert np.allclose([first[c]["explained"] for c in range(1, 17)], values / np.trace(cov), rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_exact_sums():
    """Sums of squares are exact whatever the size of the entries."""
    for scale in (3, 10**5, 10**9, 10**14):
        y = np.array([[scale - 1, -scale, 7], [scale, 1, -scale]], np.int64)
        total: dict = {}
        whitening.pair_squares(y, total)
        whitening.pair_squares(y[:, :1], total)
        every = [[int(v) for v in row] + [int(row[0])] for row in y]
        assert total == {(0, 0): sum(a * a for a in every[0]), (1, 1): sum(b * b for b in every[1]), (0, 1): sum((a + b) ** 2 for a, b in zip(*every, strict=True))}
    for v in (0, -1, 5, -(2**70), 2**100 + 3):
        assert sum(x << 32 * k for k, x in enumerate(whitening._limbs(v))) == v


def test_covariance_is_that_of_fractions(spark):
    """Entries far from zero with a tiny spread: nothing cancels."""
    data = [(k, [1e9 + (k % 7) / 64, 1e9 - (k % 5) / 64, k / 64]) for k in range(60)]
    codes = whitening.packed(frame(spark, data, "double")).select("code").distinct()
    model = whitening.fit(codes, 3)
    x = sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in data})
    n, mean = len(x), [Fraction(sum(c), len(x)) for c in zip(*x, strict=True)]
    cov = [[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x) / n) for j in range(3)] for i in range(3)]
    back = model.vectors @ np.diag(model.values) @ model.vectors.T
    assert model.n == n and np.allclose(back, cov, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("data", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])]])
def test_nothing_to_whiten(spark, data):
    out = whitening.op13_whitening(frame(spark, data))
    assert out.count() == 0 and out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_few_dimensions_and_overflow(spark):
    data = [(k, [float(k), float(-k)]) for k in range(9)] + [(10, [2.0**44, 0.0])]
    got = whitening.op13_whitening(frame(spark, data, "double")).collect()
    assert {r["component"] for r in got} == {1} and [r["deviation"] for r in got if r["vec_id"] == 10] == [None]  # the second is zero to rounding
    assert {r["component"] for r in whitening.op13_whitening(frame(spark, data[:9], "double")).collect()} == {1}
