"""The operators over vectors against brute force, on awkward rows and on none."""

import numpy as np
import pytest

from trendlab.llm import caps, common, topk

VECTORS = "vec_id long, embedding array<float>, label int, node string, cap int, q int, block int"


def rows_of(vectors, start=0):
    return [(start + i, None if v is None else [None if x is None else float(x) for x in v], 1, "n", 2, 3, 4) for i, v in enumerate(vectors)]


@pytest.fixture
def awkward():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(140, 12)).astype(np.float32)
    v[30:60] = v[30] + 0.15 * rng.normal(size=(30, 12)).astype(np.float32)  # a group of near copies
    v[70:80] = v[70]  # equal vectors
    v[90] = 3 * v[91]  # one direction, two lengths
    rows = rows_of(v) + rows_of([None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1e30] * 12, [1.0] * 5], 140)
    return [*rows, rows[31], (None, *rows[70][1:])]


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_top_k(spark, awkward):
    rows = [r for r in awkward if r[0] != 146]  # scores there do not fit 64 bits
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, VECTORS).repartition(4), every=10, k=5).collect()]
    q = {}
    every = []
    for r in rows:
        if sound(r[1]) and r[0] is not None:
            x = np.floor(256 * np.array(r[1], np.float64)).astype(np.int64)
            x = np.concatenate((x, np.zeros(12 - len(x), np.int64)))
            every.append((r[0], x))
            q[r[0]] = x
    want = []
    for i in q:
        if i % 10 == 0:
            best = sorted(((-int(x @ q[i]), j) for j, x in every if j != i))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_blocks_prune_without_loss():
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(3000, 16)) * rng.lognormal(0, 1, (3000, 1)) * 100).astype(np.int64)
    rows[:50] = rows[50:100]  # ties
    ids = rng.permutation(3000)
    turn = np.linalg.svd(rows.astype(float), full_matrices=False)[2].T
    q, c, s = topk.search_block(ids[:20], rows[:20], np.full(20, -np.inf), ids, rows, turn, 5)
    for k in range(20):
        score = rows @ rows[k]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[k]][:5]
        mine = [(int(x), int(y)) for x, y in zip(c[q == k], s[q == k])]
        assert mine == [(int(ids[i]), int(score[i])) for i in order]


def test_top_k_edges(spark):
    none = topk.top_k(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
    two = topk.top_k(spark.createDataFrame(rows_of([[1.0, 0.5], [0.5, 0.5]]), VECTORS))
    assert [tuple(r) for r in two.collect()] == [(0, 1, 1, 256 * 128 + 128 * 128)]


def brute_links(rows, cosine=0.9):
    n = len(rows)
    links = [set() for _ in range(n)]
    unit = [None] * n
    for i, r in enumerate(rows):
        if sound(r[1]) and any(r[1]):
            v = np.array(r[1], np.float64)
            unit[i] = v / np.linalg.norm(v)
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i].add(j)
                links[j].add(i)
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in links[i]:
                label[i] = label[j] = min(label[i], label[j])
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((r[0], len(links[i]), low, r[0] == low if links[i] or r[0] is not None else True))
    return out


@pytest.mark.parametrize("block", [8, 2048])
def test_near_duplicate_vectors(spark, awkward, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    got = sorted((tuple(r) for r in caps.near_duplicates(spark.createDataFrame(awkward, VECTORS).repartition(4)).collect()), key=str)
    assert got == sorted(brute_links(awkward), key=str)


def test_every_exceeding_direction_is_listed():
    rng = np.random.default_rng(2)
    code = caps.make_code(12, 5000, 0.9)
    units = caps.unit_rows(rng.normal(size=(40, 12)))
    rows, found = caps.list_decode(code, units)
    turned, directions, at = units @ code.rotation, np.zeros((1, 0)), 0
    for book in code.books:
        directions = np.concatenate((np.repeat(directions, len(book), axis=0), np.tile(book, (len(directions), 1))), axis=1)
    products = turned @ directions.T
    for i in range(40):
        mine = set(found[rows == i].tolist())
        limit = code.threshold
        while (products[i] >= limit).sum() < code.least:
            limit -= 0.05
        assert mine == set(np.flatnonzero(products[i] >= limit).tolist())


def test_recall_at_the_threshold():
    """Pairs just over the threshold share a cap nearly always."""
    rng = np.random.default_rng(3)
    for n in (2000, 200_000):
        code = caps.make_code(64, n, 0.9)
        a = caps.unit_rows(rng.normal(size=(300, 64)))
        b = rng.normal(size=(300, 64))
        b -= (b * a).sum(axis=1, keepdims=True) * a
        b = 0.901 * a + (1 - 0.901**2) ** 0.5 * caps.unit_rows(b)
        x, y = caps.list_decode(code, a), caps.list_decode(code, b)
        shared = sum(bool(set(x[1][x[0] == i]) & set(y[1][y[0] == i])) for i in range(300))
        assert shared >= 298


def test_empty_vectors(spark):
    assert caps.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    only = caps.near_duplicates(spark.createDataFrame(rows_of([None, [0.0, 0.0]]), VECTORS)).collect()
    assert sorted(map(tuple, only)) == [(0, 0, 0, True), (1, 0, 1, True)]


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(701, 760)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame([*pairs, (3, None), (5, 5)], "a long, b long")).collect()}
    label = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in range(len(label)):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
