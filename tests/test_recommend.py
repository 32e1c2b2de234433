import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendlab.operators import insights, recommend as rec

N_DATES, N = 20, 40
DATES = [dt.date(2024, 1, 1) + dt.timedelta(days=15 * i) for i in range(N_DATES)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(N, 8))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    curves = np.log10(rng.integers(1, 300_000, size=(N, N_DATES)) + 1.0)
    curves[3] = curves[3, 0]  # constant
    terms = [f"blue item{i:02d} for set" for i in range(N)]
    return terms, vectors, curves


@pytest.fixture(scope="module")
def features(spark, data):
    rows = [(t, [float(x) for x in v], c.tolist()) for t, v, c in zip(*data)]
    return spark.createDataFrame(rows, "term string, vector array<float>, curve array<double>")


@pytest.fixture(scope="module")
def dates(spark):
    return spark.createDataFrame([(d,) for d in DATES], "report_date date")


def expected(data, seed, ws, wt, k):
    terms, vectors, curves = data
    i = terms.index(seed)
    v = vectors.astype(float)
    sim = v @ v[i]
    c = curves - curves.mean(axis=1, keepdims=True)
    den = np.linalg.norm(c, axis=1) * np.linalg.norm(c[i])
    flat = curves.max(axis=1) == curves.min(axis=1)
    corr = np.where(flat | flat[i], 0.0, c @ c[i] / np.where(den == 0, 1, den))
    final = np.round(ws * sim + wt * (corr + 1) / 2, 9)
    order = sorted(range(N), key=lambda j: (-final[j], terms[j]))[:k]
    return [(terms[j], final[j], sim[j], corr[j]) for j in order if j != i]


@pytest.mark.parametrize("seed_at,ws,wt,k", [(0, 0.6, 0.4, 20), (3, 0.5, 0.5, 50), (7, 0.0, 1.0, 5)])
def test_recommend(features, data, seed_at, ws, wt, k):
    seed = data[0][seed_at]
    want = expected(data, seed, ws, wt, k)
    got = rec.recommend(features, seed, ws, wt, k).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, len(want) + 1))
    assert [r.term for r in got] == [w[0] for w in want]
    for name, at in (("final_score", 1), ("semantic_score", 2), ("trend_corr", 3)):
        assert [r[name] for r in got] == pytest.approx([w[at] for w in want], abs=1e-8)
    assert all(abs(r.trend_corr) <= 1 + 1e-9 for r in got)


def test_unknown_seed_gives_nothing(features):
    assert rec.recommend(features, "absent").count() == 0
    assert rec.semantic_neighbors(features, "absent").count() == 0
    assert rec.trend_correlation(features, "absent").count() == 0


def test_semantic_neighbors_and_missing_vectors(features, data):
    terms, vectors, _ = data
    v = vectors.astype(float)
    sim = v @ v[0]
    want = [terms[j] for j in np.argsort(-sim)[:10] if j != 0]
    assert [r.term for r in rec.semantic_neighbors(features, terms[0], 10).orderBy("pos").collect()] == want
    bare = features.withColumn("vector", F.lit(None).cast("array<float>"))
    assert rec.semantic_neighbors(bare, terms[0]).count() == 0


def test_text_variants(spark):
    terms = spark.createDataFrame([(t,) for t in ("Blue shoe", "shoes", "red", "blu", "sky blue", "a b")], "term string")
    assert [r.term for r in rec.text_variants(terms, "blue of").collect()] == ["Blue shoe", "sky blue"]
    assert [r.term for r in rec.text_variants(terms, "BLUE shoe", 2).collect()] == ["Blue shoe", "shoes"]
    assert rec.text_variants(terms, "a b").count() == 0


def test_volatility_and_seasonality(features, data, dates):
    recs = rec.recommend(features, data[0][0], 0.5, 0.5, 10)
    ranks = {t: np.power(10, c) - 1 for t, c in zip(data[0], data[2])}
    for r in insights.volatility(recs).collect():
        assert (r.volatility, r.avg_rank) == pytest.approx((np.std(ranks[r.term]), np.mean(ranks[r.term])))
    chosen = [r.term for r in recs.select("term").collect()]
    got = {r.month: r.heat for r in insights.seasonality(recs, dates).collect()}
    assert sorted(got) == list(range(1, 13))
    for month in range(1, 13):
        hot = [x for t in chosen for d, x in zip(DATES, ranks[t]) if d.month == month and x < 100_000]
        assert got[month] == pytest.approx(100_000 / (np.mean(hot) + 1) if hot else 0.0)
    assert got[12] == 0.0


def test_attributes(spark):
    recs = spark.createDataFrame(
        [(1, "Red shoe for men"), (2, "shoe lace red ox"), (3, "lace of gold")], "pos int, term string"
    )
    rows = [(r.word, r["count"]) for r in insights.attributes(recs, "ox gold").collect()]
    assert rows == [("red", 2), ("shoe", 2), ("lace", 2)]


def test_quadrants(spark):
    recs = spark.createDataFrame(
        [("a", 0.7, 0.5), ("b", 0.69, 0.5), ("c", 0.7, 0.49), ("d", 0.1, -0.2)],
        "term string, semantic_score double, trend_corr double",
    )
    got = {r.term: r.quadrant for r in insights.quadrants(recs).collect()}
    assert got == {"a": "substitute", "b": "complement", "c": "semantic_only", "d": "weak"}


def test_compare_views(spark, features, data, dates):
    terms, _, curves = data
    seed = terms[0]
    recs = rec.recommend(features, seed, k=10)
    first = [r.term for r in recs.orderBy("pos").limit(5).collect()]
    rows = insights.trend_compare(features, dates, seed, recs).toPandas()
    assert set(rows[rows.type == "Seed"].term) == {seed}
    assert set(rows[rows.type == "Recommendation"].term) == set(first) and len(rows) == 6 * N_DATES
    only = insights.trend_compare(features, dates, seed, recs, chosen=[first[2], "absent"]).toPandas()
    assert set(only[only.type == "Recommendation"].term) == {first[2]}

    chosen = rec.compare_set(seed, recs.limit(0), spark.createDataFrame([(terms[1],), (seed,), ("absent",)], "term string"))
    plot = insights.plot_rows(features, dates, chosen)
    assert {r.term for r in plot.collect()} == {seed, terms[1]}
    wide = insights.viewer_pivot(plot, [seed, terms[1]]).collect()
    assert [r.date for r in wide] == DATES[::-1]
    assert wide[0][seed] == pytest.approx(10 ** curves[0, -1] - 1)

    short = insights.plot_rows(features, dates.where(F.col("report_date") < DATES[5]), chosen)
    assert short.count() == 2 * 5
