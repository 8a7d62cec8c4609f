"""Whitening against a dense eigen-decomposition, with exact integers where they are promised."""

from __future__ import annotations

import numpy as np
import pytest

from runloom.llm import whitening
from runloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, whitened double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", 1, 0.0) for i, v in rows], SCHEMA)


def brute(vectors, k=whitening.COMPONENTS):
    """x, whitened values (up to sign), explained shares, deviations."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(fit), fit.sum(0)
    centre = lambda a: np.array([[float(int(n * c - t)) / n for c, t in zip(r, s)] for r in a])
    values, axes = np.linalg.eigh(centre(fit).T @ centre(fit) / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    real = values > 1e-12 * np.abs(values).max()
    trace = (centre(fit) ** 2).sum() / n
    deviations = [int(((n * r - s) ** 2).sum()) for r in x]
    return n, centre(x) @ axes[:, real] / np.sqrt(values[real]), values[real] / trace, deviations


def check(rows, ids, vectors):
    n, expected, explained, deviations = brute(vectors)
    k = len(explained)
    assert len(rows) == len(ids) * k
    got = {(r.vec_id, r.component): r for r in rows}
    white = np.array([[got[i, c + 1].whitened for c in range(k)] for i in ids])
    signs = np.sign((white * expected).sum(0))
    assert np.abs(white * signs - expected).max() < 1e-7
    assert [got[i, 1].deviation for i in ids] == deviations
    assert {r.n for r in rows} == {n}
    assert np.allclose([got[ids[0], c + 1].explained for c in range(k)], explained, rtol=1e-9)
    assert rows[0].identity_error < 1e-9


def test_query_is_the_dense_result(spark):
    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check(QUERIES["op11_whitening"](spark, sf).collect(), [r.vec_id for r in source], [r.embedding for r in source])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(40)] + [(100, [3.0, -2.0, 1e4, 0.0, -0.0])]
    good += [(200 + i, good[0][1]) for i in range(30)] + [(300, [1.0]), (301, [])]  # copies, short ones
    bad = [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0]), (402, [float("nan")] * 5), (403, [1.0, float("inf"), 0.0, 0.0, 0.0])]
    rows = whitening.whitened(table(spark, good + bad)).collect()
    check(rows, [i for i, _ in good], [v + [0.0] * (5 - len(v)) for _, v in good])
    without_id = whitening.whitened(table(spark, [*good, (None, good[3][1])])).where("vec_id IS NULL").collect()
    assert sorted(r.component for r in without_id) == [1, 2, 3, 4, 5]


def test_no_variance_no_components(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whitened(table(spark, rows)).collect() == []
    flat = whitening.whitened(table(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0])])).collect()
    assert [(r.vec_id, r.component) for r in flat] == [(1, 1), (2, 1)] and abs(flat[0].whitened) == pytest.approx(1)


def test_too_large_an_entry_is_refused(spark):
    with pytest.raises(Exception, match="too large to whiten"):
        whitening.whitened(table(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])])).collect()


def test_deviation_stays_exact_or_fails():
    moments = whitening.Moments(3_000_000, np.array([1_000_000]), np.array([7]))
    model = whitening.Whitener(moments, np.ones(1), np.ones((1, 1)), 1.0, 0.0, 0.0)
    assert model.deviation(np.array([[1_000_999]])).tolist() == [(3_000_000 * 999 - 7) ** 2]
    with pytest.raises(OverflowError):
        model.deviation(np.array([[1_000_000 + 2**30]]))


@pytest.mark.parametrize("spectrum", ["even", "close", "one large", "low rank"])
def test_eigenpairs_of_a_wide_operator(spectrum):
    """300 dimensions: the basis is restarted, never the whole space."""
    rng = np.random.default_rng(1)
    values = {
        "even": np.linspace(1, 100, 300), "close": 1 + 1e-3 * rng.random(300) + np.r_[np.full(16, 0.5) + 0.01 * np.arange(16), np.zeros(284)],
        "one large": np.r_[1e6, rng.random(299) + np.r_[np.linspace(2, 3, 20), np.zeros(279)]], "low rank": np.r_[np.arange(1, 11.0), np.zeros(290)],
    }[spectrum]
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    matrix = (q * values) @ q.T
    products, columns = [], []

    def apply(x):
        products.append(1)
        columns.append(x.shape[1])
        return matrix @ x

    found, vectors, worst = whitening.jacobi_davidson(apply, 300, 16)
    assert np.allclose(found, np.sort(values)[::-1][:16], rtol=0, atol=1e-12 * values.max())
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 1e-12 * values.max()
    assert len(products) < 300 and worst <= 1e-12 * values.max()
