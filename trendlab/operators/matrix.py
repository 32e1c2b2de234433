"""The term x date matrix of log ranks, kept long (one row per cell) or as one curve per term.

Everything that works per term shuffles by ``term`` once: ``filter_terms``, ``densify`` and
``curves`` chained on one another reuse that partitioning. A term's group holds at most one row per
report date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trendlab.functions import bind, log_rank

RANK_CAP = 2_000_000


def date_axis(best: DataFrame, keep_empty_dates: bool = False) -> DataFrame:
    """The report dates of best ranks (or of a cleaned log): the columns of the matrix.

    Taken before terms are filtered, so that filtering never shortens the axis. A date without any
    valid rank is on it only with ``keep_empty_dates``. Derived from the same best ranks as the
    matrix, the axis reuses their shuffle instead of reading the log again.
    """
    used = best if keep_empty_dates else best.where(F.col("rank").isNotNull())
    return used.select("report_date").where(F.col("report_date").isNotNull()).distinct()


def axis_array(dates: DataFrame) -> Column:
    """Sorted dates as one array value, evaluated once as a scalar subquery.

    With DATEs the calendar bounds the array; with times the number of distinct report times does.
    """
    return dates.agg(F.array_sort(F.collect_set("report_date")).alias("dates")).scalar()


def filter_terms(best: DataFrame, cap: float = RANK_CAP) -> DataFrame:
    """Cells of the terms whose best rank is strictly below ``cap``; other cells stay unclipped."""
    per_term = Window.partitionBy("term")
    return best.withColumn("_best", F.min("rank").over(per_term)).where(F.col("_best") < cap).drop("_best")


def filter_summary(best: DataFrame, cap: float = RANK_CAP) -> DataFrame:
    """Number of terms before and after ``filter_terms`` and the share removed in percent."""
    terms = best.groupBy("term").agg(F.min("rank").alias("rank"))
    before, after = F.count("term"), F.count_if(F.col("rank") < cap)
    removed = F.try_divide((before - after) * F.lit(100.0), before)
    return terms.agg(before.alias("before"), after.alias("after"), removed.alias("removed_pct"))


def _dense_arrays(best: DataFrame, dates: DataFrame, fill: Column, value: Column) -> DataFrame:
    """One array per term over the whole date axis: ``term, best, filled``.

    Each cell gets its place on the axis from a join with the dates. Per term the cells are sorted
    by place and the gaps before, between and after them are filled with runs of ``fill``, so the
    work is linear in the axis and no dense row is shuffled.
    """
    axis = dates.sparkSession.range(1).select(F.posexplode(axis_array(dates)).alias("at", "report_date"))
    placed = best.where(F.col("rank").isNotNull()).join(axis, "report_date")
    cell = F.struct("at", value.alias("value"))
    per_term = placed.groupBy("term").agg(
        F.min("rank").alias("best"), F.sort_array(F.collect_list(cell)).alias("known")
    ).withColumn("n_dates", F.size(axis_array(dates)))

    def run(cells: Column, x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(cells[F.greatest(i - 1, F.lit(0))]["at"])
        return F.concat(F.array_repeat(fill, x["at"] - before - 1), F.array(x["value"]))

    runs = bind(F.col("known"), lambda c: F.transform(c, lambda x, i: run(c, x, i)))
    tail = F.array_repeat(fill, F.col("n_dates") - 1 - F.element_at("known", -1)["at"])
    return per_term.select("term", "best", F.concat(F.flatten(runs), tail).alias("filled"))


def densify(best: DataFrame, dates: DataFrame, fill: float = RANK_CAP) -> DataFrame:
    """Every (term, date) cell, with ``fill`` where a term has no rank.

    The dates come from their own DataFrame because filtering terms must not shorten the axis.
    """
    dense = _dense_arrays(best, dates, F.lit(float(fill)), F.col("rank").cast("double"))
    return cells(dense.select("term", F.col("filled").alias("curve")), dates, "rank")


def to_log(matrix: DataFrame) -> DataFrame:
    return matrix.select("term", "report_date", log_rank(F.col("rank")).alias("log_rank"))


def curves(matrix: DataFrame) -> DataFrame:
    """One array of log ranks per term, in date order."""
    ordered = F.sort_array(F.collect_list(F.struct("report_date", "log_rank")))
    return matrix.groupBy("term").agg(F.transform(ordered, lambda c: c["log_rank"]).alias("curve"))


def trend_curves(
    best: DataFrame, dates: DataFrame, cap: float = RANK_CAP, fill: float = RANK_CAP
) -> DataFrame:
    """``curves(to_log(densify(filter_terms(best, cap), dates, fill)))`` in a single aggregation.

    The filter runs on the aggregate, and each curve is built from its own cells, so the dense
    cells never exist as rows.
    """
    filled = log_rank(F.lit(float(fill)))
    dense = _dense_arrays(best, dates, filled, log_rank(F.col("rank")))
    return dense.where(F.col("best") < cap).select("term", F.col("filled").alias("curve"))


def cells(curve_df: DataFrame, dates: DataFrame, value: str = "log_rank") -> DataFrame:
    """Curves back to one row per (term, date), without a join; cut to the shorter of the two."""
    axis = axis_array(dates)
    n = F.least(F.size(axis), F.size("curve"))
    pairs = F.arrays_zip(
        F.slice(axis, F.lit(1), n).alias("report_date"), F.slice("curve", F.lit(1), n).alias(value)
    )
    return curve_df.select("term", F.inline(pairs).alias("report_date", value))


def pivot_matrix(matrix: DataFrame, dates: list, value: str = "rank") -> DataFrame:
    """Wide form: one row per term, one column per date of the list. For display, not for the main path."""
    return matrix.groupBy("term").pivot("report_date", dates).agg(F.min(value))


def matrix_stats(matrix: DataFrame) -> DataFrame:
    """Shape, extremes, mean and population deviation of the long matrix, as one row.

    Aggregating by term first keeps the partitioning the matrix already has and makes the shape
    plain counts: the matrix is complete (see ``verify``), so a term has one cell per date.
    """
    per_term = matrix.groupBy("term").agg(
        F.count("log_rank").alias("n"),
        F.avg("log_rank").alias("mean"),
        F.var_pop("log_rank").alias("var"),
        F.min("log_rank").alias("low"),
        F.max("log_rank").alias("high"),
        F.min("report_date").alias("first"),
        F.max("report_date").alias("last"),
    )
    n, mean, var = F.col("n"), F.col("mean"), F.col("var")
    grand = F.try_divide(F.sum(n * mean), F.sum(n))
    # The mean first, then squared distances from it: no digits are lost when the spread is small.
    centre = per_term.agg(grand.alias("centre")).scalar()
    per_term = per_term.withColumn("off", mean - centre)
    variance = F.try_divide(F.sum(n * (var + F.col("off") * F.col("off"))), F.sum(n))
    return per_term.agg(
        F.count("term").alias("n_terms"),
        F.coalesce(F.max("n"), F.lit(0)).alias("n_dates"),
        F.min("low").alias("min_value"),
        F.max("high").alias("max_value"),
        grand.alias("mean_value"),
        F.sqrt(variance).alias("std_value"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
    )


def duplicate_terms(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def verify(matrix: DataFrame, terms: DataFrame, dates: DataFrame) -> DataFrame:
    """Checks of a finished matrix: one row ``check, value, passed`` each, plus ``all``.

    ``value`` counts offences, so 0 passes everywhere but in the three ``has_`` rows, which count
    the rows of a part and need at least one.
    """
    def by_term(df: DataFrame) -> DataFrame:
        return df.groupBy("term").agg(F.count(F.lit(1)).alias("n"))

    term_counts = by_term(terms).agg(
        F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("terms"))
    ).scalar()
    date_rows = dates.select("report_date").distinct().agg(F.count(F.lit(1))).scalar()
    bad = F.count_if(F.col("log_rank").isNull() | F.isnan("log_rank"))
    facts = (
        matrix.groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"), bad.alias("bad"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
            F.count(F.lit(1)).alias("matrix_terms"),
        )
        .withColumns({"counts": term_counts, "date_rows": date_rows})
        .select("*", F.col("counts.rows").alias("term_rows"), F.col("counts.terms").alias("distinct_terms"))
    )

    def check(name: str, value: Column, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), value.cast("long").alias("value"), passed.alias("passed"))

    n, term_n, date_n = F.col("n"), F.col("term_rows"), F.col("date_rows")
    zero_checks = {
        "null_cells": F.col("bad"),
        "duplicate_terms": term_n - F.col("distinct_terms"),
        "term_mismatch": F.abs(F.col("matrix_terms") - term_n),
        "cell_mismatch": F.abs(n - term_n * date_n),
    }
    presence = {"has_matrix": n, "has_terms": term_n, "has_dates": date_n}
    rows = [check(k, v, v == 0) for k, v in zero_checks.items()]
    rows += [check(k, v, v > 0) for k, v in presence.items()]
    checks = F.array(*rows)
    failed = F.size(F.filter(checks, lambda r: ~r["passed"]))
    return facts.select(F.inline(F.concat(checks, F.array(check("all", failed, failed == 0)))))
