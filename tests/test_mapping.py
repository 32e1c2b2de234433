import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendlab.operators import mapping as m
from trendlab.operators.neighbors import embed_terms, knn_join


def brute_force(terms, vectors, k, floor=None):
    v = np.asarray(vectors, dtype=np.float32).astype(np.float64)
    sims = np.floor(v @ v.T * 1e9 + 0.5) / 1e9
    out = {}
    for i, t in enumerate(terms):
        order = sorted(range(len(terms)), key=lambda j: (-sims[i, j], terms[j]))[:k]
        out[t] = [(terms[j], sims[i, j]) for j in order if floor is None or sims[i, j] >= floor]
    return {t: n for t, n in out.items() if n}


def joined(df):
    out = {}
    for r in df.orderBy("term", "pos").collect():
        out.setdefault(r.term, []).append((r.neighbor, r.sim))
        assert r.pos == len(out[r.term])
    return out


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("floor", [None, 0.3, 0.99])
@pytest.mark.parametrize("block_rows", [None, 7, 40])
def test_knn_equals_brute_force(spark, floor, block_rows):
    rng = np.random.default_rng(3)
    vectors = unit(rng.normal(size=(100, 8)))
    vectors[40:75] = vectors[0]  # A third of the terms share one vector: ties must fall to term order.
    terms = [f"term {i * 37 % 100:03d}" for i in range(100)]
    df = spark.createDataFrame(
        [(t, [float(np.float32(x)) for x in v]) for t, v in zip(terms, vectors)], "term string, vector array<float>"
    )
    got = joined(knn_join(df, 5, floor, block_rows))
    want = brute_force(terms, vectors, 5, floor)
    assert got.keys() == want.keys()
    for t in want:
        assert [n for n, _ in got[t]] == [n for n, _ in want[t]]
        assert [s for _, s in got[t]] == pytest.approx([s for _, s in want[t]], abs=2e-9)


def test_knn_threshold_inside_equals_filter_outside(spark):
    terms = spark.range(300).select(F.concat(F.lit("red item "), F.col("id") % 37, F.lit(" x"), F.col("id")).alias("term"))
    vectors = embed_terms(terms)
    inside = knn_join(vectors, 20, 0.8, 64)
    outside = knn_join(vectors, 20, None, 64).where("sim >= 0.8")
    assert joined(inside) == joined(outside)


def test_executors_need_no_package(tmp_path):
    """Only the driver can import the package; workers start elsewhere and without it."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
from trendlab.operators.neighbors import embed_terms, knn_join
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
terms = spark.createDataFrame([("red shoe",), ("red shoes",), ("lamp",)], "term string")
print("found", knn_join(embed_terms(terms), threshold=0.75).count())
"""
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
    )
    assert "found 5" in done.stdout, done.stderr[-2000:]


def test_knn_of_nothing(spark):
    empty = spark.createDataFrame([], "term string, vector array<float>")
    assert knn_join(empty, 5).count() == 0


NEIGHBORS = [
    ("long red shoe", "long red shoe", 1.0, 1), ("long red shoe", "red shoes", 0.9, 2),
    ("long red shoe", "redshoe x", 0.8, 3), ("long red shoe", "abcdefghij", 0.74, 4),
    ("lonely", "lonely", 1.0, 1),
]


@pytest.fixture
def neighbors(spark):
    return spark.createDataFrame(NEIGHBORS, "term string, neighbor string, sim double, pos int")


def test_canonical_rules(spark, neighbors):
    vocab = spark.createDataFrame([(t,) for t in ("long red shoe", "lonely", "no vector")], "term string")
    got = {r.term: r for r in m.canonical(neighbors, vocab, "shortest").collect()}
    # Equal length: the more similar neighbour wins.
    assert (got["long red shoe"].canonical, got["long red shoe"].group_size) == ("red shoes", 3)
    assert (got["lonely"].canonical, got["lonely"].max_similarity) == ("lonely", 1.0)
    assert (got["no vector"].canonical, got["no vector"].group_size) == ("no vector", 0)
    fewest = {r.term: r.canonical for r in m.canonical(neighbors, vocab, "fewest_words").collect()}
    assert fewest["long red shoe"] == "abcdefghij"
    with pytest.raises(ValueError):
        m.canonical(neighbors, vocab, "longest")


def test_lists_and_statistics(spark):
    mapping = spark.createDataFrame(
        [("a", "b", 2, 1.0), ("b", "c", 4, 1.0), ("c", "c", 1, 1.0), ("d", "b", 4, 1.0)],
        "term string, canonical string, group_size long, max_similarity double",
    )
    changes = m.change_log(mapping)
    assert [r.original for r in m.change_log_order(changes).collect()] == ["b", "d", "a"]
    assert [r.original for r in m.change_log_order(changes, "vocabulary").collect()] == ["a", "b", "d"]
    assert [r.term for r in m.mapping_sample(mapping, 2).collect()] == ["a", "b"]
    s = m.mapping_stats(mapping, 0.75).first()
    assert (s.total, s.changed, s.changed_pct, s.mean_group_size, s.threshold) == (4, 3, 75.0, pytest.approx(10 / 3), 0.75)
    empty = m.mapping_stats(mapping.where("false"), 0.75).first()
    assert empty.total == 0 and empty.changed_pct is None

    log = spark.createDataFrame([("a", 1), ("z", 2), ("a", 3)], "term string, n int")
    rows = {r.n: r.mapped_term for r in m.apply_mapping(log, mapping).collect()}
    assert rows == {1: "b", 2: "z", 3: "b"}  # One hop: a stays on b although b maps on.
