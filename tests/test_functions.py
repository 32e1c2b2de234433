import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendlab import functions as fn


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text,rank",
    [
        ("1,234", 1234.0), ("1,234,567", 1234567.0), ("7", 7.0), (" 12 ", 12.0), ("1e3", 1000.0), ("3.", 3.0),
        (".5", 0.5), ("inf", math.inf), ("abc", None), ("", None), ("1d", None), ("2F", None), ("NaN", None),
        ("-", None), (None, None), ("1 2", None),
    ],
)
def test_parse_rank(spark, text, rank):
    assert values(spark, [text], fn.parse_rank) == [rank]
    assert values(spark, [text], lambda c: F.coalesce(fn.is_rank(c), F.lit(False))) == [rank is not None]


def test_parse_date(spark):
    texts = ["2024-01-06", "2024/1/6", "20240106", "2024-01-06 10:11:12", "1/6/2024", "12345", "soon", "", None]
    day = dt.date(2024, 1, 6)
    assert values(spark, texts, fn.parse_date) == [day] * 5 + [None] * 4


def test_log_rank_and_back(spark):
    ranks = [0.0, 1.0, 9.0, 99_999.0, 2_000_000.0]
    logs = values(spark, ranks, fn.log_rank, "double")
    assert logs == pytest.approx(np.log10(np.array(ranks) + 1), abs=1e-12)
    assert values(spark, ranks, lambda c: F.round(fn.inverse_rank(fn.log_rank(c)), 6), "double") == ranks


def test_words_and_tokens(spark):
    text = "  Red\tRUNNING  shoes a　b of été \n"
    assert values(spark, [text], fn.words) == [text.split()]
    assert values(spark, [text], fn.tokens) == [[w for w in text.lower().split() if len(w) > 2]]
    assert values(spark, ["", "  ", "a b"], fn.word_count) == [0, 0, 2]
    assert values(spark, ["", "héé", "😀a"], fn.char_count) == [0, 3, 2]


def test_cosine_and_normalise(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=16), rng.normal(size=16)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), [0.0] * 4)], "a array<double>, b array<double>, z array<double>")
    row = df.select(
        fn.cosine(fn.l2_normalize(F.col("a")), fn.l2_normalize(F.col("b"))).alias("c"),
        fn.l2_normalize(F.col("z")).alias("z"),
    ).first()
    assert row.c == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
    assert row.z is None


def test_pearson(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=30), rng.normal(size=30)
    flat = [0.1] * 30
    df = spark.createDataFrame([(a.tolist(), b.tolist(), flat)], "a array<double>, b array<double>, f array<double>")
    pairs = [("a", "b"), ("a", "a"), ("a", "f"), ("f", "a"), ("f", "f")]
    row = df.select(*(fn.pearson(F.col(x), F.col(y)).alias(f"c{i}") for i, (x, y) in enumerate(pairs))).first()
    assert list(row) == pytest.approx([np.corrcoef(a, b)[0, 1], 1.0, 0.0, 0.0, 0.0], abs=1e-12)


def test_model_embedder_loads_once_per_task_and_batches(spark):
    def load():
        class Model:
            def encode(self, texts):
                assert len(texts) <= 2
                return np.array([[len(t), t.count("a"), 1.0] for t in texts], dtype=np.float32)

        return Model()

    from trendlab.operators.neighbors import embed_terms

    df = spark.createDataFrame([("a",), ("banana",), ("xyz",)], "term string").coalesce(1)
    got = {r.term: r.vector for r in embed_terms(df, fn.model_embedder(load, batch_size=2)).collect()}
    raw = np.array([6, 3, 1.0])
    assert got["banana"] == pytest.approx(raw / np.linalg.norm(raw), abs=1e-6)
    assert len(got) == 3


def test_ngram_embedder_short_and_null_terms(spark):
    from trendlab.operators.neighbors import embed_terms

    df = spark.createDataFrame([("",), ("a",), ("abc",), (None,)], "term string")
    got = {r.term: r.vector for r in embed_terms(df).collect()}
    assert got[""] is None and got[None] is None
    assert np.linalg.norm(got["a"]) == pytest.approx(1.0, abs=1e-6)
    assert len(got["abc"]) == 64


def test_parse_time(spark):
    texts = ["2024-01-08", "2024/1/8 08:00", "2024-1-8 20:00", "1/8/2024 20:15:30", "2024-01-08T20:00:00.5Z", "2024-01-08 late", "20240108", "soon", None]
    day = dt.datetime(2024, 1, 8)
    times = [day, day.replace(hour=8), day.replace(hour=20), day.replace(hour=20, minute=15, second=30), day.replace(hour=20, microsecond=500_000), day, day, None, None]
    assert values(spark, texts, fn.parse_time) == times
    assert values(spark, texts, lambda c: fn.parse_time(c).cast("date")) == values(spark, texts, fn.parse_date)


def test_dates_are_matched_once_per_row(spark):
    df = spark.createDataFrame([("1/6/2024 3:04 PM",), ("Jan 6, 2024 15:04",), ("\u0002",), (None,)], "x string")
    for parse in (fn.parse_time, fn.parse_date):
        plan = df.select(parse(F.col("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") == 1
    at = dt.datetime(2024, 1, 6, 15, 4)
    assert [r.y for r in df.select(fn.parse_time(F.col("x")).alias("y")).collect()] == [at, at, None, None]
