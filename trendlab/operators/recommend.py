"""Scoring all terms against one seed term.

The seed's vector and curve enter as a scalar subquery, i.e. as one value, so scoring is a
projection over the feature table followed by a top-k: no join and no shuffle of the terms. An
unknown seed gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from trendlab.functions import centred, cosine, norm, pearson_to
from trendlab.operators.tiles import SIM_DIGITS

MIN_TOKEN = 3


def load_features(curves: DataFrame, vectors: DataFrame, how: str = "inner") -> DataFrame:
    """Curves and vectors of the same term. ``how="left"`` keeps terms that have no vector."""
    return curves.join(vectors, "term", how).select("term", "vector", "curve")


def _seed_value(features: DataFrame, seed: str, *values: Column) -> Column:
    row = features.where(F.col("term") == seed).select(F.struct(*values).alias("seed"))
    return row.agg(F.first("seed").alias("seed")).scalar()


def _top_k(scored: DataFrame, seed: str, score: str, k: int) -> DataFrame:
    """The k best by score, then without the seed, which normally leaves k - 1 rows."""
    top = scored.orderBy(F.desc_nulls_last(score), F.asc("term")).limit(k)
    # A null score sorts last. Filtering it out before the limit would be pushed down, past the
    # aggregation that made the features, and score rows instead of terms.
    top = top.where(F.col(score).isNotNull() & (F.col("term") != seed))
    # At most k rows are left, so numbering them in one partition is safe.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(score), F.asc("term"))
    return top.withColumn("pos", F.row_number().over(order))


def trend_correlation(features: DataFrame, seed: str) -> DataFrame:
    """Pearson correlation of each term's curve with the seed's: ``term, trend_corr``."""
    target = centred(F.col("curve"))
    value = _seed_value(features, seed, target.alias("target"), norm(target).alias("norm"))
    return (
        features.withColumn("_seed", value)
        .where(F.col("_seed").isNotNull())
        .select("term", pearson_to(F.col("curve"), F.col("_seed.target"), F.col("_seed.norm")).alias("trend_corr"))
    )


def recommend(
    features: DataFrame, seed: str, w_semantic: float = 0.6, w_trend: float = 0.4, k: int = 20
) -> DataFrame:
    """Terms by ``w_semantic * cosine + w_trend * (correlation + 1) / 2``.

    Returns ``pos, term, final_score, semantic_score, trend_corr, trend_curve``. Scores are rounded
    before ranking, so that ties fall to term order. The weights are used as given.
    """
    target = centred(F.col("curve"))
    value = _seed_value(
        features, seed, F.col("vector"), target.alias("target"), norm(target).alias("norm")
    )
    scored = (
        features.withColumn("_seed", value)
        .where(F.col("_seed").isNotNull())
        .select(
            "term",
            F.round(cosine(F.col("vector"), F.col("_seed.vector")), SIM_DIGITS).alias("semantic_score"),
            F.round(
                pearson_to(F.col("curve"), F.col("_seed.target"), F.col("_seed.norm")), SIM_DIGITS
            ).alias("trend_corr"),
            F.col("curve").alias("trend_curve"),
        )
    )
    trend01 = (F.col("trend_corr") + 1) / 2
    final = F.lit(float(w_semantic)) * F.col("semantic_score") + F.lit(float(w_trend)) * trend01
    return _top_k(scored.withColumn("final_score", F.round(final, SIM_DIGITS)), seed, "final_score", k).select(
        "pos", "term", "final_score", "semantic_score", "trend_corr", "trend_curve"
    )


def semantic_scores(features: DataFrame, seed: str) -> DataFrame:
    """Cosine of every term with the seed; null for a term without a vector."""
    value = _seed_value(features, seed, F.col("vector"))
    return (
        features.withColumn("_seed", value["vector"])
        .where(F.col("_seed").isNotNull())
        .select("term", F.round(cosine(F.col("vector"), F.col("_seed")), SIM_DIGITS).alias("score"))
    )


def semantic_neighbors(features: DataFrame, seed: str, k: int = 20) -> DataFrame:
    """The most similar terms of the seed by vector alone: ``pos, term, score``."""
    return _top_k(semantic_scores(features, seed), seed, "score", k).select("pos", "term", "score")


def text_variants(terms: DataFrame, seed: str, n: int = 50) -> DataFrame:
    """The first ``n`` terms, in term order, that contain one of the seed's longer words."""
    lowered = F.lower("term")
    hits = [lowered.contains(w) for w in seed.lower().split() if len(w) >= MIN_TOKEN]
    matches = reduce(lambda a, b: a | b, hits, F.lit(False))
    return terms.where(matches & (F.col("term") != seed)).select("term").orderBy("term").limit(n)


def compare_set(seed: str, *choices: DataFrame) -> DataFrame:
    """The seed and all chosen terms, each once."""
    spark = choices[0].sparkSession
    seed_row = spark.range(1).select(F.lit(seed).alias("term"))
    return reduce(DataFrame.unionByName, [c.select("term") for c in choices], seed_row).distinct()
