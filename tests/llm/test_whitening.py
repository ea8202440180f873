"""Operator 11 against numpy's eigenvectors, and its two factorings on their own."""

import numpy as np
import pytest

from trackwise.llm.whitening import components, one_sided_jacobi, pivoted_cholesky, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, w string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", "w") for i, v in vectors], SCHEMA)


def brute(vectors, keep=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(float)) + 100000
    n, c = len(x), x - x.mean(0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:keep], v[:, ::-1][:, :keep]
    xi = x.astype(object)
    s = xi.sum(0)
    return c @ v / np.sqrt(e), e / np.trace(c.T @ c / n), [int(((n * r - s) ** 2).sum()) for r in xi]


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.1, 12))).astype(np.float32)
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(vectors)]
    bad = [(900, None), (901, [float("nan")] * 12), (902, [float("inf")] + [0.0] * 11), (903, [None] + [0.0] * 11), (904, [1.0]), (905, [])]
    got = whiten(frame(spark, rows + bad)).collect()
    want, share, deviation = brute(vectors)
    assert {r.vec_id for r in got} == set(range(300)) and len(got) == 300 * 8 and {r.n for r in got} == {300}
    w = np.zeros((300, 8))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
    for k in range(8):
        assert min(np.abs(w[:, k] - want[:, k]).max(), np.abs(w[:, k] + want[:, k]).max()) < 1e-7
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_low_rank_equal_and_empty(spark):
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)] + [(3, [3.0, 6.0, 5.0]), (None, [4.0, 8.0, 5.0])]
    got = whiten(frame(spark, line)).collect()
    assert len(got) == 22 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)
    assert len([r for r in got if r.vec_id == 3]) == 2 and len([r for r in got if r.vec_id is None]) == 1
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten(frame(spark, [])).count() == 0 and whiten(frame(spark, [(1, None)])).columns == got[0].__fields__


def test_deviation_beyond_a_long(spark):
    got = whiten(frame(spark, [(1, [4e6, 0.0]), (2, [-4e6, 1.0]), (3, [0.0, 3.0])])).collect()
    x = [[1024 * 4_000_000 + 100000, 100000], [-1024 * 4_000_000 + 100000, 101024], [100000, 103072]]
    s = [sum(c) for c in zip(*x)]
    for r in got:
        exact = sum((3 * e - t) ** 2 for e, t in zip(x[r.vec_id - 1], s))
        assert r.deviation == (exact if exact < 2**63 else None)
    assert any(r.deviation is None for r in got) and any(r.deviation for r in got)


@pytest.mark.parametrize("rank", [1, 7, 15, 16])
def test_factoring(rank):
    rng = np.random.default_rng(rank)
    b = rng.normal(size=(16, rank))
    a = b @ b.T
    low, order = pivoted_cholesky(a)
    assert low.shape[1] == rank and np.allclose(np.triu(low, 1), 0)
    assert np.allclose(low @ low.T, a[np.ix_(order, order)])
    values, vectors = components(a, 2)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank] / 2)
    assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
    assert np.allclose(vectors * values @ vectors.T, a / 2)


def test_jacobi_keeps_small_values():
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 6)))
    want = np.array([1e6, 1.0, 1e-3, 1e-6, 1e-9, 1e-12])
    values, _ = one_sided_jacobi(q * np.sqrt(want))
    assert np.allclose(values, want, rtol=1e-9)
