"""The neighbour join with centres: exact against brute force, and tiles pruned."""

import numpy as np
import pytest

from trendlab.operators import neighbors


def brute(vectors, k, threshold):
    terms = sorted(t for t, v in vectors if v is not None)
    x = {t: np.array(v, dtype=np.float32).astype(np.float64) for t, v in vectors if v is not None}
    out = set()
    for t in terms:
        sims = sorted(((-round(float(x[t] @ x[u]), 9), u) for u in terms), key=lambda p: (p[0], p[1]))
        kept = [(u, -s) for s, u in sims if threshold is None or -s >= threshold][:k]
        out |= {(t, u, round(s, 6), i + 1) for i, (u, s) in enumerate(kept)}
    return out


@pytest.fixture
def clustered():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 16))
    rows = []
    for c in range(6):
        pts = centres[c] + 0.05 * rng.normal(size=(60, 16))
        pts /= np.linalg.norm(pts, axis=1, keepdims=True)
        rows += [(f"t{c}-{i}", p.tolist()) for i, p in enumerate(pts)]
    rows += [("null", None), ("zero", [0.0] * 16)]
    return rows


@pytest.mark.parametrize("k,threshold", [(5, 0.9), (7, None)])
def test_pruned_and_exact(spark, clustered, k, threshold):
    df = spark.createDataFrame(clustered, "term string, vector array<float>")
    report = {}
    got = neighbors.knn_join(df, k=k, threshold=threshold, block_rows=40, report=report).collect()
    sound = [(t, v) for t, v in clustered if v is not None and len(v) == 16 and any(v)]
    want = brute(sound, k, threshold)
    assert {(r.term, r.neighbor, round(r.sim, 6), r.pos) for r in got if r.term in dict(sound) and r.neighbor in dict(sound)} == want
    assert report["blocks"] > 6  # clusters of 60 rows are split into blocks of at most 40
    assert report["tiles"] < report["possible"]


def _rows_out_of_python(df):
    """Rows that the Python steps of an executed plan have given."""
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        n = 0
        if "InArrow" in name:
            n = node.metrics().apply("pythonNumRowsReceived").value()
        children = node.children()
        return n + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_lists_are_joined_where_they_are_made(spark):
    """However many blocks there are, no more than k rows per term leave the tasks."""
    x = np.random.default_rng(2).normal(size=(600, 8))
    df = spark.createDataFrame([(f"t{i}", v.tolist()) for i, v in enumerate(x)], "term string, vector array<float>")
    report = {}
    out = neighbors.knn_join(df, k=4, block_rows=40, report=report)
    assert len(out.collect()) == 600 * 4
    assert report["blocks"] >= 15 and 0 < _rows_out_of_python(out) <= 600 * 4


def test_repeated_and_missing_terms(spark):
    """Rows of one term each bring their list, of which the term keeps the k best."""
    x = np.random.default_rng(4).normal(size=(90, 6))
    rows = [(None if i % 30 == 7 else f"t{i % 60:02d}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "term string, vector array<double>")
    got = {}
    for r in neighbors.knn_join(df, k=3, block_rows=11).collect():
        got.setdefault(r.term, {})[r.pos] = (r.neighbor, round(r.sim, 6))
    sims = x @ x.T
    for term in {t for t, _ in rows}:
        best = sorted(((round(float(sims[i, j]), 6), rows[j][0]) for i, r in enumerate(rows) if r[0] == term
                       for j in range(90)), key=lambda p: (-p[0], p[1] is not None, p[1] or ""))[:3]
        assert [got[term][p + 1] for p in range(3)] == [(n, s) for s, n in best]
