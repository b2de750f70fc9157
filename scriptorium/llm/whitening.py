"""Whitening of embeddings by a compensated covariance.

Entries become whole numbers x. The covariance is that of the distinct vectors
(the fit list): each vector is centred in double-double (a pair of a high and a
low double) and cut, without error, into slices of few bits. The sum of the
outer products of two slices over a block of rows is then exact in doubles
whatever its order, so it is one matrix product; blocks are added in
double-double by error-free sums. A task gives one row of high and low parts for
each row of the matrix; those of all tasks are added the same way, a matrix row
at a time. The eigenvectors come from LAPACK's ``syevd`` by way of numpy:
reduction to tridiagonal form, then divide and conquer; two steps of refinement
against the unrounded covariance give them in full double precision.

The driver holds a matrix of dims by dims, never rows of the table.

Cases: vectors that are null or empty, that hold null or non-finite entries, or
an entry of 2^40 or more (whose x and sums would not be exact), are left out, and
so are vectors of another length than the most frequent one (of equally frequent
ones, the shortest); equal vectors count once in the fit list, and each of their
rows gets its own results; a component whose eigenvalue is below
``dims * 1e-13`` of the largest has no direction and is left out, so equal
vectors only, or an empty table, give an empty result; a deviation that no long
can hold is null; a null or repeated id stays as it is; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import written

#: Rows of a block and bits of a slice: a sum of BLOCK products of two slices has at most 10 + 2 * 21 bits.
BLOCK, BITS, SLICES = 1024, 21, 3
SHIFT, SCALE = 1_000_000, 64
_MOST = 2.0**40


def two_sum(a, b):
    """a + b as a rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add_pairs(hi, lo, more_hi, more_lo):
    """Sum of two double-doubles."""
    s, e = two_sum(hi, more_hi)
    t, f = two_sum(lo, more_lo)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x less a double-double mean, in double-double."""
    hi, lo = two_sum(x.astype(float), -mean[0])
    return two_sum(hi, lo - mean[1])


def slices(hi: np.ndarray, lo: np.ndarray, bits: float) -> list[np.ndarray]:
    """Slices of BITS bits each that add to hi + lo, but for what lies below the last; all entries are under 2^bits."""
    out = []
    for k in range(SLICES):
        unit = 2.0 ** (bits - BITS * (k + 1))
        part = np.rint(hi / unit) * unit
        hi, lo = two_sum(hi - part, lo)
        out.append(part)
    return out


class Covariance:
    """Sums of outer products of centred rows, in double-double."""

    def __init__(self, dims: int):
        self.hi, self.lo = np.zeros((dims, dims)), np.zeros((dims, dims))

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for at in range(0, len(hi), BLOCK):
            a, b = hi[at : at + BLOCK], lo[at : at + BLOCK]
            top = float(np.abs(a).max(initial=0.0))
            if top == 0.0:
                continue
            # One bit more, as the first slice rounds up.
            cut = slices(a, b, np.ceil(np.log2(top)) + 1)
            for i in range(SLICES):
                for j in range(SLICES - i):
                    self.hi, self.lo = add_pairs(self.hi, self.lo, cut[i].T @ cut[j], 0.0)

    def rows(self) -> list[tuple[int, bytes, bytes]]:
        return [(i, self.hi[i].tobytes(), self.lo[i].tobytes()) for i in range(len(self.hi))]


def whole_numbers(vector: Column) -> Column:
    """x of each entry; null for a vector that is left out."""
    entry = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < _MOST / SCALE)
    fits = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry)
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return F.when(fits, x)


def _matrix(x: pa.Array, dims: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each entry, which go in two halves so that no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for b in batches:
            x = _matrix(b.column(0), dims)
            n, high, low = n + len(x), high + (x >> 24).sum(0), low + (x & 0xFFFFFF).sum(0)
        got = {"d": range(dims), "n": [n] * dims, "high": high, "low": low}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in got.items()})

    got = fit.select("x").mapInArrow(run, "d long, n long, high long, low long").groupBy("d").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")
    )
    rows = {r.d: r for r in got.collect()}  # dims rows
    return (rows[0].n, [(rows[d].high << 24) + rows[d].low for d in range(dims)]) if rows else (0, [])


def _double_double(value: Fraction) -> tuple[float, float]:
    hi = float(value)
    return hi, float(value - Fraction(hi))


def _added(parts: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of all tasks' matrices; each row of the matrix meets in one task, a row for each task before."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            for i, hi, lo in zip(*(b.column(k).to_pylist() for k in range(3))):
                new = np.frombuffer(hi), np.frombuffer(lo)
                held[i] = add_pairs(*held[i], *new) if i in held else new
        got = [(i, hi.tobytes(), lo.tobytes()) for i, (hi, lo) in held.items()]
        if got:
            yield _record(got)

    got = parts.repartition("i").mapInArrow(add, "i int, hi binary, lo binary").collect()  # dims rows
    hi, lo = np.zeros((dims, dims)), np.zeros((dims, dims))
    for r in got:
        hi[r.i], lo[r.i] = np.frombuffer(r.hi), np.frombuffer(r.lo)
    return hi, lo


def _record(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    i, hi, lo = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(hi, pa.binary()), pa.array(lo, pa.binary())], names=["i", "hi", "lo"])


def eigen(hi: np.ndarray, lo: np.ndarray, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric double-double matrix."""
    hi, lo = (hi + hi.T) / 2, (lo + lo.T) / 2
    _, vectors = np.linalg.eigh(hi + lo)
    exact = hi.astype(np.longdouble) + lo.astype(np.longdouble)
    v = vectors[:, ::-1].astype(np.longdouble)
    for _ in range(steps + 1):
        r = np.eye(len(v)) - v.T @ v
        s = v.T @ exact @ v
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        gap, middle = values[None, :] - values[:, None], (values[None, :] + values[:, None]) / 2
        near = np.abs(gap) <= 1e-14 * np.abs(values).max(initial=0.0)
        # Half of r makes them orthonormal; the other part, a rotation, parts those whose values differ.
        v = v + v @ (r / 2 + np.where(near, 0, (s + middle * r) / np.where(near, 1, gap)))
    order = np.argsort(-values, kind="stable")
    v = v[:, order] / np.sqrt((v[:, order] ** 2).sum(0))
    return values[order].astype(float), v.astype(float)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = df.sparkSession
    at = df.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col)).alias("x")).where("x IS NOT NULL")
    at = written(at, "vectors")
    lengths = at.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths.d
    at = at.where(F.size("x") == dims)
    fit = written(at.select("x").distinct(), "fit-list")
    n, sums = _sums(fit, dims)
    mean = tuple(np.array(p) for p in zip(*(_double_double(Fraction(s, n)) for s in sums)))

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Covariance(dims)
        for b in batches:
            total.add(*centred(_matrix(b.column(0), dims), mean))
        yield _record(total.rows())

    hi, lo = _added(fit.mapInArrow(outer, "i int, hi binary, lo binary"), dims)
    values, vectors = eigen(hi, lo)
    kept = [k for k in range(min(components, dims)) if values[k] > values[0] * dims * 1e-13 and values[k] > 0]
    if not kept:
        return spark.createDataFrame([], schema)
    explained = [float(values[k] / values.sum()) for k in kept]
    scaled = vectors[:, kept] / np.sqrt(values[kept] / n)

    def projected(x: np.ndarray) -> np.ndarray:
        a, b = centred(x, mean)
        return a @ scaled + b @ scaled

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The mean of what is projected is that of centred rows: zero, but for rounding.
        total, zero = Covariance(len(kept)), None
        for b in batches:
            y = projected(_matrix(b.column(0), dims))
            zero = np.zeros_like(y) if zero is None or len(zero) != len(y) else zero
            total.add(y, zero)
        yield _record(total.rows())

    again = _added(fit.mapInArrow(check, "i int, hi binary, lo binary"), len(kept))[0] / n
    error = float(np.abs(again - np.eye(len(kept))).max())
    near = np.array([int(round(Fraction(s, n))) for s in sums])
    rest = np.array([s - n * int(m) for s, m in zip(sums, near)])  # n * x - S = n * (x - near) - rest

    def deviations(x: np.ndarray) -> list[int | None]:
        part = x - near
        if n * (float(np.abs(part).max(initial=0)) + 1) < 2.0**31 / np.sqrt(dims):
            return ((n * part - rest) ** 2).sum(1).tolist()
        exact = ((n * part.astype(object) - rest.astype(object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dims)
            y = projected(x)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(kept))
            columns = [b.column(0), pa.array(deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "y"])

    got = at.select("vec_id", "x").mapInArrow(project, "vec_id long, deviation long, y array<double>")
    got = got.select("vec_id", "deviation", F.posexplode("y").alias("k", "whitened"))
    return got.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, explained)), F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
