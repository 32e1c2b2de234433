import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from trendlab.operators import logs, mapping as m, matrix as mx

D = [dt.date(2024, 1, 1) + dt.timedelta(weeks=i) for i in range(4)]


@pytest.fixture
def raw(spark):
    rows = [
        ("a", D[0], "7"), ("a", D[0], "3"), ("a", D[2], "1,000"), ("a", None, "1"),
        ("b", D[1], "2,000,000"), ("c", D[1], "1,999,999"), ("c", D[2], "5,000,000"),
        (None, D[0], "1"), ("d", D[3], "bad"), ("null", D[2], "12"),
    ]
    return spark.createDataFrame(rows, "term string, report_date date, rank_raw string")


def as_cells(df, value):
    return {(r.term, r.report_date): r[value] for r in df.collect()}


def test_clean_keeps_null_like_terms_and_drops_bad_rows(raw):
    rows = logs.clean_log(raw).collect()
    assert {r.term for r in rows} == {"a", "b", "c", "null"}
    assert len(rows) == 7
    assert {r.term for r in logs.clean_log(raw, keep_empty_dates=True).collect()} == {"a", "b", "c", "d", "null"}


def test_vocabulary(raw):
    vocab = logs.build_vocab(raw)
    assert sorted(r.term for r in vocab.collect()) == ["a", "b", "c", "d", "null"]
    row = logs.vocab_stats(vocab).first()
    assert (row.terms, row.mean_length) == (5, 1.6)


def test_matrix_cells(raw):
    best = logs.best_rank(logs.clean_log(raw))
    assert as_cells(best, "rank")[("a", D[0])] == 3.0
    dates = mx.date_axis(best)
    dense = mx.densify(mx.filter_terms(best), dates)
    fill = 2_000_000.0
    # b has its best rank exactly at the cap and goes; the cell of c above the cap stays as it is.
    assert as_cells(dense, "rank") == {
        ("a", D[0]): 3.0, ("a", D[1]): fill, ("a", D[2]): 1000.0,
        ("c", D[0]): fill, ("c", D[1]): 1_999_999.0, ("c", D[2]): 5_000_000.0,
        ("null", D[0]): fill, ("null", D[1]): fill, ("null", D[2]): 12.0,
    }
    row = mx.filter_summary(best).first()
    assert (row.before, row.after, row.removed_pct) == (4, 3, 25.0)


def test_empty_date_stays_only_on_request(raw):
    def axis(keep):
        best = logs.best_rank(logs.clean_log(raw, keep))
        return best, mx.date_axis(best, keep)

    _, dates = axis(False)
    assert {r.report_date for r in dates.collect()} == set(D[:3])
    best, dates = axis(True)
    assert {r.report_date for r in dates.collect()} == set(D)
    dense = as_cells(mx.densify(mx.filter_terms(best), dates), "rank")
    assert {t for t, _ in dense} == {"a", "c", "null"} and len(dense) == 12


def test_one_step_curves_equal_the_chain(raw):
    best = logs.best_rank(logs.clean_log(raw))
    dates = mx.date_axis(best)
    chain = mx.curves(mx.to_log(mx.densify(mx.filter_terms(best), dates)))
    direct = mx.trend_curves(best, dates)
    as_dict = lambda df: {r.term: r.curve for r in df.collect()}
    assert as_dict(direct) == as_dict(chain)
    assert as_dict(direct)["null"] == [math.log10(2_000_001)] * 2 + [math.log10(13)]
    assert as_cells(mx.cells(direct, dates), "log_rank") == as_cells(
        mx.to_log(mx.densify(mx.filter_terms(best), dates)), "log_rank"
    )


def test_file_order_does_not_matter(spark, raw):
    best = lambda df: as_cells(logs.best_rank(logs.clean_log(df)), "rank")
    assert best(raw) == best(raw.orderBy(F.desc("rank_raw")).repartition(5))


def test_pivot(raw):
    best = logs.best_rank(logs.clean_log(raw))
    wide = mx.pivot_matrix(mx.densify(best, mx.date_axis(best)), D[:2])
    assert wide.columns == ["term", str(D[0]), str(D[1])]
    assert {r.term: r[1] for r in wide.collect()}["a"] == 3.0


def test_deviation_of_a_narrow_spread(spark):
    rows = [(f"t{i}", D[j], 1e6 + 1e-4 * (i + j)) for i in range(20) for j in range(3)]
    long = spark.createDataFrame(rows, "term string, report_date date, log_rank double")
    values = [r[2] for r in rows]
    mean = math.fsum(values) / len(values)
    want = math.sqrt(math.fsum((v - mean) ** 2 for v in values) / len(values))
    assert mx.matrix_stats(long).first().std_value == pytest.approx(want, rel=1e-6)


def test_stats_and_verify(raw):
    best = logs.best_rank(logs.clean_log(raw))
    dates = mx.date_axis(best)
    curves = mx.trend_curves(best, dates)
    long = mx.cells(curves, dates)
    plain = long.agg(F.avg("log_rank"), F.stddev_pop("log_rank"), F.min("log_rank"), F.max("log_rank")).first()
    row = mx.matrix_stats(long).first()
    assert [row.mean_value, row.std_value, row.min_value, row.max_value] == pytest.approx(list(plain), abs=1e-12)
    assert (row.n_terms, row.n_dates, row.first_date, row.last_date) == (3, 3, D[0], D[2])

    checks = lambda *a: {r.check: (r.value, r.passed) for r in mx.verify(*a).collect()}
    good = checks(long, curves.select("term"), dates)
    assert all(p for _, p in good.values()) and good["all"] == (0, True)
    twice = curves.select("term").unionByName(curves.select("term").where("term = 'a'"))
    broken = checks(long.where("not (term = 'a' and log_rank < 1)"), twice, dates)
    assert broken["duplicate_terms"] == (1, False) and broken["cell_mismatch"][1] is False
    assert broken["all"][1] is False
    nothing = checks(long.where("false"), curves.select("term").where("false"), dates)
    assert nothing["has_matrix"] == (0, False) and nothing["all"][1] is False
    assert mx.duplicate_terms(twice).collect()[0].asDict() == {"term": "a", "count": 2}


def test_hot_term_and_date(spark):
    """A term and a date holding a third of the rows each."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("term"),
        F.expr("date_add(date'2024-01-01', cast(if(id % 3 = 1, 0, id % 50) as int))").alias("report_date"),
        ((F.col("id") * 7919) % 10_007 + 1).cast("double").alias("rank"),
    )
    best = logs.best_rank(rows)
    expected = rows.toPandas().groupby(["term", "report_date"])["rank"].min().to_dict()
    assert as_cells(best, "rank") == expected
    curves = mx.trend_curves(best, mx.date_axis(best))
    assert curves.where(F.size("curve") != 50).count() == 0 and curves.count() == 501


def test_mapping_before_or_after_reduction_is_the_same(spark, raw):
    mapping = spark.createDataFrame([("a", "c"), ("c", "b")], "term string, canonical string")
    clean = logs.clean_log(raw)
    plain = logs.best_rank(m.apply_mapping(clean, mapping), "mapped_term")
    reduced = m.mapped_best_rank(logs.log_best_rank(raw), mapping)
    assert as_cells(reduced, "rank") == as_cells(plain, "rank")


@pytest.mark.parametrize("keep", [False, True])
def test_best_ranks_of_a_raw_log(raw, keep):
    chain = logs.best_rank(logs.clean_log(raw, keep))
    assert as_cells(logs.log_best_rank(raw, keep), "rank") == as_cells(chain, "rank")
