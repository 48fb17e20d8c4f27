"""Whitening against numpy on whole tables, the eigenpairs against known spectra, and odd vectors."""

from pathlib import Path

import numpy as np
import pytest

from studylens.llm import queries, whitening

FOLDER = Path("/root/testdata/sf0.001")
NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def spectra(d):
    few = min(d, 12)
    return {
        "random": np.linspace(0.1, 9, d) ** 2,
        "cluster at the border": np.r_[np.full(few, 3.0), np.linspace(0, 1, d - few)],
        "steep": 2.0 ** -np.arange(d) * 1e6,
        "few": np.r_[np.ones(min(3, d)), np.zeros(d - min(3, d))],
        "all equal": np.ones(d),
        "close": 1 + 1e-6 * np.arange(d),
    }


@pytest.mark.parametrize("d", [1, 2, 8, 9, 30, 64])
def test_eigenpairs_of_known_spectra(d):
    rng = np.random.default_rng(d)
    for name, values in spectra(d).items():
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        expected = np.sort(values)[::-1][:8]
        expected = expected[expected > expected[0] * 1e-8]
        found, vectors = whitening.leading_eigenpairs(v, 8)
        assert np.allclose(found, expected, rtol=1e-9), name
        assert np.abs(v @ vectors - vectors * found).max() <= 1e-11 * expected[0], name
        assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() <= 1e-11, name
        for s in (0.5, 1.5, 2.5):
            above = int((values > s).sum())
            assert whitening.inertia(v - s * np.eye(d))[0] == above == whitening.count_above(whitening.tridiagonal(v), s), name


def test_no_variance_has_no_components():
    assert whitening.leading_eigenpairs(np.zeros((4, 4)), 8)[0].size == 0


def plain(vectors, k=8):
    """x, deviations, eigenvalues, components and trace over all vectors, by numpy and whole numbers."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array(x, float) - np.array([s / n for s in sums])
    covariance = centred.T @ centred / n
    values, parts = np.linalg.eigh(covariance)
    return centred, deviation, values[::-1][:k], parts[:, ::-1][:, :k], np.trace(covariance)


def check(rows, vectors):
    """Rows of the operator for vectors by id."""
    ids = list(vectors)
    centred, deviation, values, parts, trace = plain([vectors[i] for i in ids])
    by = {(r["vec_id"], r["component"]): r for r in rows}
    k = len(values)
    assert len(by) == len(rows) == k * len(ids)
    w = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    expected = centred @ parts / np.sqrt(values)
    signs = np.sign((w * expected).sum(axis=0))
    assert np.allclose(w, expected * signs, atol=1e-7)
    assert [by[i, 1]["deviation"] for i in ids] == deviation
    assert {r["n"] for r in rows} == {len(ids)}
    for c in range(k):
        assert abs(by[ids[0], c + 1]["explained"] / (values[c] / trace) - 1) < 1e-9
    (error,) = {r["identity_error"] for r in rows}
    covariance = w.T @ w / len(w) - np.outer(w.mean(axis=0), w.mean(axis=0))
    assert error < 1e-9 and np.abs(covariance - np.eye(k)).max() < 1e-9


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(150, 12)) * np.linspace(0.2, 2, 12)).astype("float32")
    x[20:60] = x[3]
    sound = {i: v.tolist() for i, v in enumerate(x)}
    odd = [None, [], [float("nan")] * 12, [float("inf")] + [0.0] * 11, [None] + [0.0] * 11, [1.0] * 11, [3e38] + [0.0] * 11]
    rows = [(i, v, "x", 1) for i, v in sound.items()] + [(1000 + i, v, "x", 1) for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, k string, w int").repartition(5)
    found = whitening.whiten(table, "vec_id", "embedding")
    assert found.columns == NAMES
    check(found.collect(), sound)


def test_fewer_dimensions_repeated_and_null_ids(spark):
    vectors = [[1.0, 2.0], [1.0, 2.5], [-3.0, 0.0], [4.0, 4.0]]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(None, vectors[0]), (1, vectors[1])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(table, "vec_id", "embedding").collect()
    assert sorted({r["component"] for r in rows}) == [1, 2] and len(rows) == 12
    assert sum(r["vec_id"] is None for r in rows) == 2
    total = {c: sum(r["whitened"] ** 2 for r in rows if r["component"] == c) / 6 for c in (1, 2)}
    assert all(abs(t - 1) < 1e-9 for t in total.values())


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None], [[]]])
def test_nothing_to_whiten(spark, vectors):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = whitening.whiten(table, "vec_id", "embedding")
    assert found.collect() == [] and found.columns == NAMES


def test_sums_are_exact_and_matrices_added_in_rounds(spark):
    big = 1 << 45
    rows = [(i, [float(big + i), float(-i)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    vectors = whitening.integer_vectors(table, "vec_id", "embedding", 1, 0)
    n, sums = whitening.exact_sums(vectors)
    assert (n, sums) == (40, [40 * big + 780, -780])
    mean = [s / n for s in sums]
    in_rounds = whitening.sum_of_products(vectors, "x", mean, sum_bytes=1)
    x = np.array([[big + i, -i] for i in range(40)], float) - mean
    assert np.allclose(in_rounds, x.T @ x) and np.allclose(in_rounds, whitening.sum_of_products(vectors, "x", mean))


def test_deviations_beyond_a_long():
    x = np.array([[1 << 50, 0], [0, 0], [5, 7]], np.int64)
    sums = [int(c) for c in x.sum(axis=0)]
    exact = [sum((3 * int(a) - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert whitening.deviations(x, 3, sums) == [e if e < 1 << 63 else None for e in exact]
    small = x[2:]
    assert whitening.deviations(small, 1, [5, 7]) == [0]


@pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables")
def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    sound = {r["vec_id"]: r["embedding"] for r in rows if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])}
    found = queries.op11_whitening(spark, str(FOLDER))
    assert found.columns == NAMES
    check(found.collect(), sound)
