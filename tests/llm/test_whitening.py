"""Whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest

from millrace.llm import whitening

KIND = "vec_id long, embedding array<double>, n int, component string"


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "c") for i, v in enumerate(vectors)], KIND).repartition(parts)


def held_against_numpy(spark, vectors, wanted=32, more=()):
    got = whitening.whitened(frame(spark, [*vectors, *more]), wanted=wanted).toPandas()
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    c = x - sums / n
    _, sd, q = np.linalg.svd(c, full_matrices=False)
    k = min(wanted, int((sd > 1e-9 * sd[0]).sum()))
    e, q = sd**2 / n, q.T
    assert sorted(got.vec_id.unique()) == list(range(n)) and len(got) == n * k
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), e[:k] / e.sum(), rtol=1e-9)
    assert (got[got.component == 1].set_index("vec_id").deviation.sort_index().to_numpy() == ((n * x - sums) ** 2).sum(1)).all()
    w = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    return w, c @ q[:, :k] / np.sqrt(e[:k])


def test_components_and_deviations(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 16)) * np.linspace(0.2, 3, 16) + 7
    w, want = held_against_numpy(spark, vectors, wanted=6)
    assert np.allclose(w * np.sign((w * want).sum(0)), want, atol=1e-8)


def test_unusable_vectors_take_no_part(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 5)) * [1, 2, 3, 4, 5]
    bad = [None, [], [1, 2, None, 4, 5], [1, 2, float("nan"), 4, 5], [float("inf")] * 5, [1.0, 2.0]]
    w, want = held_against_numpy(spark, vectors, 32, bad)
    assert np.allclose(w * np.sign((w * want).sum(0)), want, atol=1e-8)


def test_low_rank_equal_deviations_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    flat = rng.normal(size=(50, 3)).round(2) @ rng.integers(-3, 4, size=(3, 12))
    w, _ = held_against_numpy(spark, flat)
    assert np.allclose(w.T @ w / len(w), np.eye(w.shape[1]), atol=1e-9)
    even = np.concatenate([np.eye(8), -np.eye(8)]) * 5  # all deviations equal: any orthonormal components do
    w, _ = held_against_numpy(spark, np.concatenate([even, even]))
    assert np.allclose(w.T @ w / len(w), np.eye(8), atol=1e-9)
    few, _ = held_against_numpy(spark, rng.normal(size=(6, 20)))
    assert few.shape == (6, 5)


def test_empty_and_constant_tables(spark):
    assert whitening.whitened(frame(spark, [[1.0]]).where("vec_id < 0")).collect() == []
    assert whitening.whitened(frame(spark, [None, []])).collect() == []
    assert whitening.whitened(frame(spark, [[2.0, 3.0]] * 4)).collect() == []


def test_huge_entries_are_bounded_and_sums_stay_exact(spark):
    vectors = [[1e300, 0.0], [-1e300, 1.0], [3.0, 2.0], [4.0, 3.0]]
    got = whitening.whitened(frame(spark, vectors)).collect()
    x = np.array([[whitening.BOUND, 1_000_000], [-whitening.BOUND, 1_000_064], [1_000_192, 1_000_128], [1_000_256, 1_000_192]], object)
    want = [int(sum((4 * c - s) ** 2 for c, s in zip(row, x.sum(0), strict=True))) for row in x]
    found = {r.vec_id: r.deviation for r in got if r.component == 1}
    assert [found[i] for i in range(4)] == [w if w < 1 << 63 else None for w in want]


@pytest.mark.parametrize("dims", [1, 2, 33])
def test_fewer_or_more_dimensions_than_components(spark, dims):
    vectors = np.random.default_rng(dims).normal(size=(80, dims))
    w, _ = held_against_numpy(spark, vectors)
    assert w.shape == (80, min(32, dims))
