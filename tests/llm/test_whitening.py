"""Whitening against numpy's eigenvectors, and its edges."""

import numpy as np
import pytest

from graniteleaf.llm import whitening


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + extra)


def expected(x: np.ndarray):
    """Sums, covariance, eigenvalues (falling) and vectors of the distinct rows, the plain way."""
    own = np.unique(x, axis=0)
    mean = own.mean(0)
    values, vectors = np.linalg.eigh((own - mean).T @ (own - mean) / len(own))
    return own, mean, values[::-1], vectors[:, ::-1]


def test_against_numpy_with_copies_and_unequal_scales(spark):
    rng = np.random.default_rng(3)
    c = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * [1, 1, 1, 0.3, 0.05, 30]).astype(np.float32)
    c = np.concatenate((c, np.repeat(c[:1], 150, axis=0)))
    rows = [(i, v.tolist()) for i, v in enumerate(c)] + [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5)]
    got = whitening.components(table(spark, rows)).toPandas()
    x = np.floor(256 * c.astype(float)).astype(np.int64)
    own, mean, values, vectors = expected(x)
    assert len(got) == 4 * len(c) and set(got["vec_id"]) == set(range(len(c)))
    assert (got["n"] == len(own)).all() and (got["identity_error"] < 1e-9).all()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (x - mean) @ vectors[:, :4] / np.sqrt(values[:4])
    signs = np.sign((wide * want).sum(0))
    np.testing.assert_allclose(wide, want * signs, atol=1e-8)
    for k in range(4):
        np.testing.assert_allclose(got.loc[got["component"] == k + 1, "explained"], values[k] / values.sum(), rtol=1e-9)
    far = ((len(own) * x - own.sum(0)) ** 2).sum(1)
    assert (got[got["component"] == 2].sort_values("vec_id")["deviation"].to_numpy() == far).all()


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    scale = 10.0 ** -np.arange(0, 8)
    a = rng.normal(size=(200, 8))
    v = (a.T @ a / 200) * np.outer(scale, scale)
    values, vectors = whitening.jacobi(v)
    np.testing.assert_allclose(vectors @ np.diag(values) @ vectors.T, v, rtol=1e-7, atol=1e-22)
    assert (np.diff(values) <= 0).all() and values[-1] > 0
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(8), atol=1e-13)
    assert np.prod(values) == pytest.approx(np.linalg.det(v / np.outer(scale, scale)) * np.prod(scale) ** 2, rel=1e-6)


def test_constant_and_repeated_dimensions_have_no_variance(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(50, 1))
    rows = [(i, [float(v), float(v), 7.0]) for i, v in enumerate(a[:, 0])]
    got = whitening.components(table(spark, rows)).toPandas()
    assert got.groupby("component")["whitened"].count().to_dict() == {1: 50, 2: 0, 3: 0}
    assert (got["identity_error"] < 1e-9).all() and got.loc[got["component"] == 1, "explained"].iloc[0] == pytest.approx(1)


def test_edges(spark):
    assert whitening.components(table(spark, [])).count() == 0
    assert whitening.components(table(spark, [(1, None), (2, [None])])).count() == 0
    assert whitening.components(table(spark, [(1, []), (2, [])])).count() == 0
    one = whitening.components(table(spark, [(1, [0.5, 1.0]), (None, [0.5, 1.0])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    assert {r["vec_id"] for r in one} == {1, None}
    with pytest.raises(ValueError, match="one length"):
        whitening.components(table(spark, [(1, [0.5]), (2, [0.5, 1.0])]))


def test_large_entries_are_exact_and_other_columns_stay(spark):
    rows = [(1, [3.0e12, 1.0], "a", 1.0), (2, [-3.0e12, 2.0], "b", 2.0), (3, [1.0e12, 5.0], "c", 3.0)]
    got, _ = whitening.whiten(table(spark, rows, ", n string, whitened double"))
    x = [[int(np.floor(256 * float(np.float32(v)))) for v in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {r[0]: sum((3 * v - s) ** 2 for v, s in zip(own, sums, strict=True)) for r, own in zip(rows, x, strict=True)}
    assert {r["vec_id"]: int(r["deviation"]) for r in got.collect()} == want
    assert got.columns == ["vec_id", "embedding", "n", "whitened", "deviation"]
