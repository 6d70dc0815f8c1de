"""Spectrum slicing against a dense eigensolver, and whitening against plain numpy."""

import math

import numpy as np
import pytest

from weekcast.llm import whitening as W


def _rotated(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    v = q @ np.diag(values) @ q.T
    return (v + v.T) / 2


def test_inertia_counts_eigenvalues_below_any_shift():
    rng = np.random.default_rng(3)
    for _ in range(200):
        d = int(rng.integers(1, 12))
        a = rng.integers(-3, 4, (d, d)).astype(float)
        a, shift = a + a.T, rng.normal() * 5
        assert W.eigenvalues_below(a, shift) == (np.linalg.eigvalsh(a) < shift).sum()
    assert W.eigenvalues_below(np.array([[0.0, 1], [1, 0]]), 0.0) == 1  # needs a 2 x 2 pivot


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [3.0, 3, 3, 2, 2, 1, 1, 1, 1, 1],  # ties across the last component
        [1e6 * 0.5**i for i in range(30)],
        [1e6] * 3 + [1 + 1e-9 * i for i in range(10)] + [0] * 17,
        [1e6 * (1 + 1e-12 * i) for i in range(12)],
        list(np.linspace(1, 2, 64)),
    ],
)
def test_leading_components_equal_the_dense_solver(values):
    v = _rotated(values)
    e, x = W.leading_components(v)
    assert len(e) == min(8, len(values))
    np.testing.assert_allclose(e, np.linalg.eigvalsh(v)[::-1][: len(e)], rtol=1e-12, atol=1e-12 * e[0])
    np.testing.assert_allclose(x @ x.T, np.eye(len(e)), atol=1e-12)
    np.testing.assert_allclose(v @ x.T, x.T * e, atol=1e-13 * e[0] * len(values))


def test_zero_eigenvalues_have_no_component():
    assert len(W.leading_components(np.zeros((4, 4)))[0]) == 0
    assert len(W.leading_components(np.ones((6, 6)))[0]) == 1


def _expected(vectors):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    deviation = [int(sum(int(n * a - s) ** 2 for a, s in zip(row, sums))) for row in x.tolist()]
    return n, deviation, centred, e[::-1], q[:, ::-1], v


def test_whiten_equals_numpy_and_skips_unusable_rows(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 10)) @ rng.standard_normal((10, 10))).astype(np.float32).tolist()
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    bad = [(900, None), (901, [math.nan] + vectors[0][1:]), (902, [None] + vectors[0][1:]), (903, [math.inf] + vectors[0][1:]), (904, [1.0]), (905, []), (906, [1e30] * 10)]
    rows += [(i, v, "x") for i, v in bad] + [(None, vectors[5], "null id"), (5, vectors[5], "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").repartition(7)
    got = W.whiten(df).collect()
    n, deviation, centred, e, q, v = _expected([r[1] for r in rows if r[0] is None or r[0] < 900])
    assert n == 302 and len(got) == n * 8
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert sorted(r.component for r in got if r.vec_id == 5) == sorted([*range(1, 9)] * 2)
    signs = {}
    for r in got:
        if r.vec_id is None:
            continue
        k = r.component - 1
        want = centred[r.vec_id] @ q[:, k] / math.sqrt(e[k])
        assert r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(e[k] / np.trace(v), rel=1e-10)
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-8)
        if abs(want) > 1e-6:
            signs.setdefault(k, set()).add(np.sign(want) == np.sign(r.whitened))
    assert all(len(s) == 1 for s in signs.values())


def test_whiten_of_equal_one_and_no_vectors_is_empty(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert W.whiten(spark.createDataFrame(rows, schema)).collect() == []


def test_two_dimensions_give_two_components(spark):
    got = W.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [5.0, 5.0])], "vec_id int, embedding array<double>"))
    assert got.schema["vec_id"].dataType.simpleString() == "int"
    assert sorted((r.vec_id, r.component) for r in got.collect()) == [(i, k) for i in (1, 2, 3) for k in (1, 2)]


def test_deviation_stays_exact_beyond_long_products():
    model = W.Whitening(2**40, np.array([0, 0]), np.ones(1), np.ones((1, 2)), 1.0)
    with pytest.raises(OverflowError):
        __import__("pyarrow").array(model.deviation(np.array([[2**30, 1]])), "int64")
    assert model.deviation(np.array([[3, 4]])).tolist() == [25 * 2**80]
