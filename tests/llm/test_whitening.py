"""Whitening against numpy's eigen-decomposition of the explicit covariance."""

import numpy as np
import pytest

from trendlab.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, key int, p int"


def brute(rows):
    x = {}
    for vid, v, *_ in rows:
        if v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v):
            continue
        x.setdefault(len(v), []).append((vid, tuple(int(np.floor(64 * float(np.float32(c))))+ 1_000_000 for c in v)))
    d = max(x, key=lambda k: (len(x[k]), k))
    kept = x[d]
    fit = np.array(sorted({v for _, v in kept}), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    cov = y.T @ y / n
    w, u = np.linalg.eigh(cov)
    order = np.argsort(-w)
    return kept, n, s, w[order], u[:, order], np.trace(cov)


@pytest.fixture
def vectors():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 24)) * np.linspace(3, 0.2, 24)
    v[50:90] = v[50]  # a hot vector
    rows = [(i, r.tolist(), 1, "x", 2, 3) for i, r in enumerate(v)]
    rows += [(300, None, 1, "x", 2, 3), (301, [], 1, "x", 2, 3), (302, [float("nan")] * 24, 1, "x", 2, 3),
             (303, [None] + [1.0] * 23, 1, "x", 2, 3), (304, [1.0] * 5, 1, "x", 2, 3), (None, v[3].tolist(), 1, "x", 2, 3),
             (305, [float("inf")] * 24, 1, "x", 2, 3), rows[7]]
    return rows


def test_whitening_against_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, VECTORS).repartition(3)
    out, report = whitening.whiten(df)
    got = out.collect()
    kept, n, s, w, u, trace = brute(vectors)
    assert len(got) == len(kept) * 16
    assert report["identity_error"] <= 1e-4
    assert np.allclose(report["eigenvalues"], w[:16], rtol=1e-9, atol=0)
    x = {}
    for vid, v in kept:
        x.setdefault(vid, v)
    for r in got:
        assert r.n == n
        v = np.array(x[r.vec_id])
        assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))
        ref = (v - s / n) @ u[:, r.component - 1] / np.sqrt(w[r.component - 1])
        assert min(abs(ref - r.whitened), abs(ref + r.whitened)) <= 1e-8 * max(1.0, abs(ref))
        assert abs(r.explained - w[r.component - 1] / trace) <= 1e-4 * w[r.component - 1] / trace
    # one sign per component for all rows
    first = {}
    for r in got:
        ref = (np.array(x[r.vec_id]) - s / n) @ u[:, r.component - 1] / np.sqrt(w[r.component - 1])
        if abs(ref) > 1e-3:
            first.setdefault(r.component, set()).add(np.sign(ref) == np.sign(r.whitened))
    assert all(len(signs) == 1 for signs in first.values())


def test_whitening_degenerate(spark):
    rows = [(1, [0.5, 0.25], 1, "x", 2, 3), (2, [0.5, 0.25], 1, "x", 2, 3), (3, None, 1, "x", 2, 3)]
    assert whitening.whiten(spark.createDataFrame(rows, VECTORS))[0].count() == 0
    assert whitening.whiten(spark.createDataFrame([], VECTORS))[0].count() == 0
