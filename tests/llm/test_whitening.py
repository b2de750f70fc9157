"""Whitening against exact rational arithmetic and numpy."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import whitening

TABLE = "vec_id long, embedding array<float>"


def exact_sums(x):
    """n * covariance of whole-number rows, as fractions."""
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    return [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n * n) for j in range(d)] for i in range(d)]


def test_covariance_is_exact_to_double_double():
    rng = np.random.default_rng(5)
    x = (rng.integers(-9, 9, (1500, 4)) * [1, 1000, 10**8, 3] + 1_000_000 + rng.integers(0, 3, (1500, 1)) * 10**11).astype(np.int64)
    n = len(x)
    mean = tuple(np.array(p) for p in zip(*(whitening._double_double(Fraction(int(s), n)) for s in x.sum(0))))
    total = whitening.Covariance(4)
    for part in np.array_split(x, 7):
        total.add(*whitening.centred(part, mean))
    want = exact_sums(x.tolist())
    for i in range(4):
        for j in range(4):
            got = Fraction(total.hi[i, j]) + Fraction(total.lo[i, j])
            scale = (want[i][i] * want[j][j]) ** Fraction(1, 2) if i == j else Fraction(float(want[i][i]) ** 0.5) * Fraction(float(want[j][j]) ** 0.5)
            assert abs(got - want[i][j]) <= Fraction(1e-17) * Fraction(scale) + Fraction(1e-12)


def test_error_free_sums():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=200) * 10.0 ** rng.integers(-12, 12, 200), rng.normal(size=200)
    s, e = whitening.two_sum(a, b)
    assert all(Fraction(p) + Fraction(q) == Fraction(u) + Fraction(v) for p, q, u, v in zip(a, b, s, e))


def test_eigenvectors_of_close_and_small_values():
    rng = np.random.default_rng(7)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    values = np.concatenate([[1e9, 1e9 - 1, 5.0, 5.0, 1e-3], np.linspace(1, 4, 25)])
    exact = (q.astype(np.longdouble) * values) @ q.T.astype(np.longdouble)
    hi = exact.astype(float)
    got, v = whitening.eigen(hi, (exact - hi).astype(float))
    assert np.allclose(np.sort(got), np.sort(values), rtol=1e-9) and np.allclose(v.T @ v, np.eye(30), atol=1e-14)
    one = np.linalg.norm(v.T @ q[:, 0])
    assert abs(abs(v[:, 0] @ q[:, 0]) - 1) < 1e-12 and one == pytest.approx(1)


def rows(n=700, dims=20, seed=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims)).astype(np.float32) @ np.diag(np.linspace(3, 0.2, dims)).astype(np.float32)
    out = [(i, v.tolist()) for i, v in enumerate(base)]
    return out + [(10_000 + i, base[3].tolist()) for i in range(40)]


ODD = [
    (None, [1.0] * 20),
    (1, [2.0] * 20),
    (20_000, None),
    (20_001, []),
    (20_002, [1.0, None] * 10),
    (20_003, [float("nan")] + [1.0] * 19),
    (20_004, [float("inf")] + [1.0] * 19),
    (20_005, [1e30] + [1.0] * 19),
    (20_006, [1.0, 2.0]),
]


def test_whitening(spark):
    data = rows() + ODD
    df = spark.createDataFrame(data, TABLE).repartition(5).withColumns({"x": F.lit(1), "n": F.lit("a"), "component": F.lit(None).cast("int")})
    got = whitening.whiten(df).toPandas()
    good = [(k, v) for k, v in data if v and len(v) == 20 and all(c is not None and np.isfinite(c) and abs(c) < 1e20 for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in good])
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(0)
    cov = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 16 * len(good) and set(got.n) == {n} and got.identity_error.max() < 1e-10
    sums = [int(s) for s in fit.sum(0)]
    want_dev = sorted(sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x)
    assert sorted(got[got.component == 1].deviation) == want_dev
    ids = {k: r for (k, _), r in zip(good, x) if k is not None and k != 1}
    for c in range(1, 17):
        own = got[(got.component == c) & got.vec_id.isin(list(ids))].set_index("vec_id")
        want = np.array([(ids[k] - mean) @ vectors[:, c - 1] / np.sqrt(values[c - 1]) for k in own.index])
        assert np.allclose(own.whitened, want, atol=1e-8) or np.allclose(own.whitened, -want, atol=1e-8)
        assert np.allclose(own.explained, values[c - 1] / values.sum(), rtol=1e-9)


def test_large_deviation_is_null_or_exact(spark):
    data = [(i, [float(i), float(2**30 * (i % 2))]) for i in range(64)]
    got = whitening.whiten(spark.createDataFrame(data, TABLE)).where("component = 1").collect()
    x = [[int(64 * a) + 1_000_000 for a in v] for _, v in data]
    sums = [sum(r[i] for r in x) for i in range(2)]
    want = [sum((64 * r[i] - sums[i]) ** 2 for i in range(2)) for r in x]
    assert {r.vec_id: r.deviation for r in got} == {i: v if v < 1 << 63 else None for i, v in enumerate(want)}


def test_too_little(spark):
    assert whitening.whiten(spark.createDataFrame([], TABLE)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], TABLE)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], TABLE)).columns[0] == "vec_id"
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 3.0, float(2 * i)]) for i in range(9)], TABLE)).collect()
    assert {r.component for r in flat} == {1}
