"""Whitening of embeddings along their leading principal components, found by FEAST contour integration.

1. ``integer_vectors`` turns vectors into whole numbers; all vectors of the prevailing length are the fit list.
2. Count and sums are one aggregation with exact numbers. The covariance is a second pass: every task centres
   its vectors and adds up their products, and the tasks' matrices are added in rounds of bounded size. What
   reaches the driver is one matrix of length x length, whatever the number of vectors.
3. ``leading_eigenpairs`` finds the components on the driver. Inertia counts (the signs of the pivots of
   V - sI, by Sylvester's law) bracket the leading eigenvalues in an interval whose ends are no eigenvalues.
   A quadrature over a circle around the interval sums complex shifted solves (zI - V) X = Y, which
   leaves of Y the part in the interval's eigenspace; a Rayleigh-Ritz step extracts the components from it, and
   both are repeated until the residuals are at rounding level. The count in the interval is known
   from the inertia: a missing component is noticed, and the search goes on with more columns.
4. Every vector is projected in a third, narrow pass, which is written down; the covariance of what was written
   gives ``identity_error``.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do
those with a component beyond 2^52 after scaling (it would have no exact whole number) or of another
length than the most frequent one (the smaller length at a tie). Null keys and repeated rows take part like others.
Directions without variance are no components, so a single vector, or equal ones, give no rows, and vectors
of fewer dimensions than components give as many as there are. ``deviation`` is null if
it exceeds a long. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize

SCALE, SHIFT = 1024, 100_000
LIMIT = float(1 << 52)
NODES = 16  # of the quadrature on the upper half circle
ROUNDS = 60
TOLERANCE = 1e-14  # of residuals, as a part of the largest eigenvalue
SUM_BYTES = 64 << 20  # matrices that one task adds up at a time


def integer_vectors(table: DataFrame, key: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(k, x) with x = floor(scale * component) + shift; faulty vectors are left out."""

    def sound(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LIMIT / scale)

    doubles = table.select(
        F.col(f"`{key}`").alias("k"), F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double")).alias("x")
    ).filter(F.coalesce(F.size("x") > 0, F.lit(False)))
    doubles = doubles.filter(F.forall("x", sound))
    whole = doubles.select("k", F.transform("x", lambda c: (F.floor(c * scale) + shift).cast("long")).alias("x"))
    lengths = whole.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return whole.filter(F.size("x") == lengths[0]["d"]) if lengths else whole.filter(F.lit(False))


def _matrix(batch: pa.RecordBatch, column: str, dtype: type) -> np.ndarray:
    values = batch.column(column)
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype).reshape(batch.num_rows, -1)


def exact_sums(vectors: DataFrame, column: str = "x") -> tuple[int, list[int]]:
    """(rows, sum of each dimension), in exact numbers; each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, column, np.int64)
            # Halves of the numbers, so that no sum of a batch overflows.
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            own = [(h << 32) + v for h, v in zip(high, low, strict=True)]
            total, n = own if total is None else [a + b for a, b in zip(total, own, strict=True)], n + len(x)
        if total is not None:
            columns = [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(t) for t in total])]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "s"])

    parts = vectors.select(column).mapInArrow(run, "i int, n long, s string")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (int(rows[0]["n"]) if rows else 0), [int(r["s"]) for r in rows]


def sum_of_products(vectors: DataFrame, column: str, centre: list[float], sum_bytes: int = SUM_BYTES) -> np.ndarray:
    """Sum over all rows of the outer product of the centred vector with itself."""
    d, mean = len(centre), np.array(centre)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch, column, np.float64) - mean
                total += own.T @ own
        part = pa.array([TaskContext.get().partitionId()], pa.int64())
        yield pa.RecordBatch.from_arrays([part, pa.array([total.tobytes()], pa.binary())], names=["part", "m"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(d * d)
        for part in table.sort_by("part").column("m"):
            total += np.frombuffer(part.as_py())
        return pa.table({"part": table.column("next").slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})

    parts = materialize(vectors.select(column).mapInArrow(products, "part long, m binary"), "products")
    fan = max(2, sum_bytes // (8 * d * d))
    while (parts.agg(F.max("part")).first()[0] or 0) >= fan:
        dealt = parts.withColumn("next", F.floor(F.col("part") / fan).cast("long"))
        parts = materialize(dealt.groupBy("next").applyInArrow(add, "part long, m binary"), "products")
    total = np.zeros(d * d)
    for row in parts.orderBy("part").collect():  # fewer than ``fan`` matrices
        total += np.frombuffer(row["m"])
    return total.reshape(d, d)


# -- eigenpairs of one symmetric matrix, on the driver ------------------------------------------------


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """(positive, negative, zero) eigenvalues of a symmetric matrix, from the pivots of Bunch and Parlett's factorisation."""
    a, alpha = np.array(a, float), (1 + math.sqrt(17)) / 8
    floor = np.abs(a).max(initial=0.0) * len(a) * np.finfo(float).eps
    positive = negative = 0
    while len(a):
        off = np.abs(np.triu(a, 1))
        largest, place = off.max(), np.unravel_index(off.argmax(), off.shape)
        best = int(np.abs(a.diagonal()).argmax())
        if max(largest, abs(a[best, best])) <= floor:
            return positive, negative, len(a)
        if abs(a[best, best]) >= alpha * largest:
            pivot = [best]
            positive, negative = positive + (a[best, best] > 0), negative + (a[best, best] < 0)
        else:
            pivot = list(place)  # a block of two with a negative determinant: one eigenvalue of either sign
            positive, negative = positive + 1, negative + 1
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        cross = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - cross @ np.linalg.solve(a[np.ix_(pivot, pivot)], cross.T)
        a = (a + a.T) / 2
    return positive, negative, 0


def tridiagonal(a: np.ndarray) -> tuple[list[float], list[float]]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix with the same eigenvalues, by Householder reflections."""
    a = np.array(a, float)
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        norm = float(np.linalg.norm(x))
        if np.abs(x[1:]).max() <= np.finfo(float).tiny:
            continue
        x[0] += math.copysign(norm, x[0])
        u = x / np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ u
        w = p - (u @ p) * u
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(u, w) + np.outer(w, u))
        a[k + 1, k] = norm
    return a.diagonal().tolist(), [e * e for e in a.diagonal(-1).tolist()]


def count_above(reduced: tuple[list[float], list[float]], s: float) -> int:
    """Eigenvalues above ``s``: the positive pivots of the shifted tridiagonal matrix."""
    diagonal, squares = reduced
    tiny, positive, pivot = 1e-290, 0, 1.0
    for d, e in zip(diagonal, [0.0, *squares], strict=True):
        pivot = d - s - e / pivot
        if abs(pivot) < tiny:
            pivot = -tiny  # at an eigenvalue, which is not above
        positive += pivot > 0
    return positive


def bracket(v: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """(low, high, m): just m >= wanted eigenvalues lie between, as few as the spectrum allows, and none at the ends.

    If fewer are positive (beyond a billionth of the matrix's norm), m is their number.
    """
    reduced = tridiagonal(v)
    high = float(np.abs(v).sum(axis=1).max()) * 1.01 + np.finfo(float).tiny
    gap = high * 1e-9
    low, above = gap, high
    if (positive := count_above(reduced, gap)) <= wanted:
        return gap, high, positive
    while above - low > gap:
        middle = (low + above) / 2
        count = count_above(reduced, middle)
        if count == wanted:
            return _widest(reduced, middle, low, above, wanted), high, wanted
        low, above = (middle, above) if count > wanted else (low, middle)
    # A cluster at the border: all of it comes in.
    low = max(low - gap, gap / 2)
    return low, high, count_above(reduced, low)


def _widest(reduced: tuple[list[float], list[float]], at: float, low: float, above: float, wanted: int) -> float:
    """A place about the middle of the gap that ``at`` lies in, where the contour is far from eigenvalues."""

    def border(inside: float, outside: float) -> float:
        for _ in range(12):
            middle = (inside + outside) / 2
            inside, outside = (middle, outside) if count_above(reduced, middle) == wanted else (inside, middle)
        return inside

    return (border(at, low) + border(at, above)) / 2


def contour_eigenpairs(v: np.ndarray, low: float, high: float, expected: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``expected`` eigenpairs between ``low`` and ``high``, by falling eigenvalue."""
    d, centre, radius = len(v), (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (nodes + 1)
    shifted = [(centre + radius * np.exp(1j * t)) * np.eye(d) - v for t in angles]
    rng, columns = np.random.default_rng(seed), min(d, expected + max(8, expected // 2))
    scale = float(np.abs(v).sum(axis=1).max())
    while True:
        y, least = rng.normal(size=(d, columns)), np.inf
        for _ in range(ROUNDS):
            q = np.zeros((d, columns))
            for t, w, matrix in zip(angles, weights, shifted, strict=True):
                # Points below the axis have the conjugate solves, so the real part stands for both.
                q += w / 2 * radius * (np.exp(1j * t) * np.linalg.solve(matrix, y.astype(complex))).real
            basis = _orthonormal(q)
            values, turned = np.linalg.eigh(basis.T @ v @ basis)
            vectors = basis @ turned
            inside = (values > low) & (values < high)
            residual = np.linalg.norm(v @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0).max(initial=0.0)
            if inside.sum() == expected and residual <= TOLERANCE * scale * math.sqrt(d):
                order = np.argsort(-values[inside], kind="stable")
                return values[inside][order], vectors[:, inside][:, order]
            if inside.sum() == expected and residual >= least * 0.5 and residual <= 1e-12 * scale:
                order = np.argsort(-values[inside], kind="stable")  # at rounding level, it falls no further
                return values[inside][order], vectors[:, inside][:, order]
            least = min(least, residual) if inside.sum() == expected else least
            y = vectors if vectors.shape[1] == columns else np.hstack([vectors, rng.normal(size=(d, columns - vectors.shape[1]))])
        if columns == d:
            raise ArithmeticError(f"found {int(inside.sum())} of {expected} eigenvalues between {low} and {high}")
        columns = min(d, 2 * columns)


def _orthonormal(q: np.ndarray) -> np.ndarray:
    """A basis of the columns, without directions that are rounding noise."""
    q = q / np.maximum(np.linalg.norm(q, axis=0), np.finfo(float).tiny)
    u, s, _ = np.linalg.svd(q, full_matrices=False)
    return u[:, s > s.max(initial=0.0) * 1e-13]


def leading_eigenpairs(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``wanted`` largest positive eigenvalues, falling, and unit eigenvectors as columns; none is missed."""
    scale = float(np.abs(v).max(initial=0.0))
    if scale == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    low, high, expected = bracket(v / scale, wanted)
    if expected == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    values, vectors = contour_eigenpairs(v / scale, low, high, expected)
    # The count once more, from factorisations of the matrix itself.
    eye = np.eye(len(v))
    if len(values) != inertia(v / scale - low * eye)[0] - inertia(v / scale - high * eye)[0]:
        raise ArithmeticError("an eigenvalue is missing")
    return values[:wanted] * scale, vectors[:, :wanted]


# -- the operator ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitener:
    """n and sums S of the fit list, eigenvalues, unit components as columns, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        # Whole and broken part by themselves, for the last digit.
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums])


def fit(vectors: DataFrame, components: int) -> Whitener:
    """Fits on all rows of ``integer_vectors``."""
    n, sums = exact_sums(vectors)
    if not n:
        return Whitener(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    mean = [s // n + (s % n) / n for s in sums]
    covariance = sum_of_products(vectors, "x", mean) / n
    values, found = leading_eigenpairs((covariance + covariance.T) / 2, components)
    return Whitener(n, sums, values, found, float(np.trace(covariance)))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, exact; null beyond a long."""
    reach = max(max(abs(n * int(x.max()) - min(sums)), abs(n * int(x.min()) - max(sums))), 1) if x.size else 1
    if reach < 1 << 62 and reach * reach * x.shape[1] < 1 << 63:
        apart = x * np.int64(n) - np.array(sums, np.int64) if n * int(np.abs(x).max(initial=0)) < 1 << 62 else None
        if apart is not None:
            return (apart * apart).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(e) if e < 1 << 63 else None for e in exact]


def transform(vectors: DataFrame, whitener: Whitener) -> DataFrame:
    """(k, deviation, w) with the whitened components of every row; narrow."""
    n, sums, mean = whitener.n, whitener.sums, whitener.mean
    onto = whitener.components / np.sqrt(whitener.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "x", np.int64)
                w = (x - mean) @ onto
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                columns = [batch.column("k"), pa.array(deviations(x, n, sums), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "deviation", "w"])

    kind = vectors.schema["k"].dataType.simpleString()
    return vectors.mapInArrow(run, f"k {kind}, deviation long, w array<double>")


def identity_error(whitened: DataFrame, n: int, components: int) -> float:
    """Largest absolute entry of the covariance of the column ``w`` minus the identity."""
    sums = whitened.select(F.posexplode("w").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).orderBy("i").collect()
    covariance = sum_of_products(whitened, "w", [r["s"] / n for r in sums]) / n
    return float(np.abs(covariance - np.eye(components)).max())


def whiten(table: DataFrame, key: str, vector: str, components: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for every sound row and each component from 1."""
    kind = table.schema[key].dataType.simpleString()
    vectors = materialize(integer_vectors(table, key, vector), "whole-vectors")
    found = fit(vectors, components)
    columns = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    count = len(found.values)
    if not count:
        empty = f"k {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return table.sparkSession.createDataFrame([], empty).toDF(key, *columns)
    whitened = materialize(transform(vectors, found), "whitened")
    error = identity_error(whitened, found.n, count)
    share = F.array(*[F.lit(float(v / found.trace)) for v in found.values])
    rows = whitened.select("k", "deviation", F.posexplode("w").alias("at", "value"))
    return rows.select(
        F.col("k"), (F.col("at") + 1).cast("int"), F.lit(found.n).cast("long"), F.col("deviation"), F.col("value"),
        F.get(share, F.col("at")), F.lit(error),
    ).toDF(key, *columns)
