"""Views over a recommendation list and over chosen curves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from trendlab.functions import inverse_rank, tokens
from trendlab.functions.arrays import bind, mean
from trendlab.operators.matrix import cells

# Fixed value: words that say nothing about a product.
STOP_WORDS = ("for", "with", "and", "in", "the", "of", "to", "a", "men", "women", "kids", "pack", "set")
HEAT_CUT = 100_000


def attributes(recs: DataFrame, seed: str, stop_words: Iterable[str] = STOP_WORDS, n: int = 10) -> DataFrame:
    """The ``n`` most frequent words of recommended terms, without stop words and seed words.

    Equal counts are ordered by first appearance in the list, which needs ``recs.pos``.
    """
    ignored = sorted({*stop_words, *seed.lower().split()})
    found = recs.select("pos", F.posexplode(tokens(F.col("term"))).alias("at", "word"))
    return (
        found.where(~F.col("word").isin(ignored))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("pos", "at")).alias("first"))
        .orderBy(F.desc("count"), F.asc("first"))
        .limit(n)
        .select("word", "count")
    )


def volatility(recs: DataFrame, curve: str = "trend_curve") -> DataFrame:
    """Population deviation and mean of a term's ranks, filled dates included, row by row."""
    ranks = F.transform(F.col(curve), lambda x: inverse_rank(x))

    def spread(r):
        return bind(mean(r), lambda m: F.sqrt(mean(F.transform(r, lambda x: (x - m) * (x - m)))))

    stats = bind(ranks, lambda r: F.struct(spread(r).alias("volatility"), mean(r).alias("avg_rank")))
    return recs.select("term", stats.alias("s")).select("term", "s.volatility", "s.avg_rank")


def seasonality(recs: DataFrame, dates: DataFrame, cut: float = HEAT_CUT) -> DataFrame:
    """Heat of the twelve months: ``cut / (mean rank + 1)`` over cells ranked below ``cut``.

    Ranks are compared as stored, i.e. after inverting the logarithm. A month without such a cell
    has heat 0.
    """
    curve = recs.select("term", F.col("trend_curve").alias("curve"))
    rank = inverse_rank(F.col("log_rank"))
    by_month = (
        cells(curve, dates)
        .select(F.month("report_date").alias("month"), rank.alias("rank"))
        .where(F.col("rank") < cut)
        .groupBy("month")
        .agg((F.lit(float(cut)) / (F.avg("rank") + 1)).alias("heat"))
    )
    months = recs.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(by_month, "month", "left").select("month", F.coalesce("heat", F.lit(0.0)).alias("heat"))


def quadrants(recs: DataFrame, sim: float = 0.7, corr: float = 0.5) -> DataFrame:
    """Place of each recommendation in the plane of meaning and trend."""
    near, together = F.col("semantic_score") >= sim, F.col("trend_corr") >= corr
    label = (
        F.when(near & together, "substitute")
        .when(together, "complement")
        .when(near, "semantic_only")
        .otherwise("weak")
    )
    return recs.select("term", "semantic_score", "trend_corr", label.alias("quadrant"))


def plot_rows(curves: DataFrame, dates: DataFrame, terms: DataFrame) -> DataFrame:
    """Ranks over time of chosen terms: ``date, term, rank``. Unknown terms are ignored."""
    chosen = curves.join(terms.select("term"), "term", "left_semi")
    return cells(chosen, dates).select(
        F.col("report_date").alias("date"), "term", inverse_rank(F.col("log_rank")).alias("rank")
    )


def trend_compare(
    features: DataFrame,
    dates: DataFrame,
    seed: str,
    recs: DataFrame,
    chosen: Iterable[str] | None = None,
    n: int = 5,
) -> DataFrame:
    """Plot rows of the seed and of the chosen, by default the first ``n``, recommendations.

    Rows carry ``type`` Seed or Recommendation.
    """
    picked = list(chosen or [])
    wanted = F.col("term").isin(picked) if picked else F.col("pos") <= n
    seed_curve = features.where(F.col("term") == seed).select("term", "curve")
    rec_curves = recs.where(wanted & (F.col("term") != seed)).select("term", F.col("trend_curve").alias("curve"))
    seed_rows = cells(seed_curve, dates).withColumn("type", F.lit("Seed"))
    rec_rows = cells(rec_curves, dates).withColumn("type", F.lit("Recommendation"))
    return seed_rows.unionByName(rec_rows).select(
        F.col("report_date").alias("date"), "term", inverse_rank(F.col("log_rank")).alias("rank"), "type"
    )


def viewer_pivot(plot: DataFrame, terms: list[str]) -> DataFrame:
    """Plot rows as a table: one row per date, newest first, one column per listed term."""
    return plot.groupBy("date").pivot("term", terms).agg(F.max("rank")).orderBy(F.desc("date"))
