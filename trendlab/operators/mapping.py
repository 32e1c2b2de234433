"""Merging near-identical spellings: the canonical term of each term, and what that changes."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame, functions as F

from trendlab.functions import char_count, word_count
from trendlab.operators.logs import best_rank

Rule = Literal["shortest", "fewest_words"]
# Keys that rows without a term are dealt out to.
NULL_KEYS = 1_000
# Similarity from which a neighbour belongs to the group, per rule.
THRESHOLDS: dict[str, float] = {"shortest": 0.75, "fewest_words": 0.725}


def canonical(
    neighbors: DataFrame, vocab: DataFrame, rule: Rule = "shortest", threshold: float | None = None
) -> DataFrame:
    """One row per term of ``vocab``: ``term, canonical, group_size, max_similarity``.

    ``shortest`` takes the neighbour with the fewest characters, ``fewest_words`` the one with the
    fewest words and then characters. Ties go to the more similar neighbour. A term without
    neighbours maps to itself with group size 0. A neighbour list holds at most ``k`` rows.
    """
    if rule not in THRESHOLDS:
        raise ValueError(f"rule must be one of {sorted(THRESHOLDS)}, not {rule!r}")
    limit = THRESHOLDS[rule] if threshold is None else threshold
    name = F.col("neighbor")
    size = [char_count(name)] if rule == "shortest" else [word_count(name), char_count(name)]
    preference = F.struct(*(s.alias(f"s{i}") for i, s in enumerate([*size, F.col("pos")])))
    groups = (
        neighbors.where(F.col("sim") >= limit)
        .groupBy("term")
        .agg(
            F.min_by("neighbor", preference).alias("canonical"),
            F.count(F.lit(1)).alias("group_size"),
            F.max("sim").alias("max_similarity"),
        )
    )
    return vocab.select("term").join(groups, "term", "left").select(
        "term",
        F.coalesce("canonical", "term").alias("canonical"),
        F.coalesce("group_size", F.lit(0)).alias("group_size"),
        "max_similarity",
    )


def change_log(mapping: DataFrame) -> DataFrame:
    """The terms that change. Sort with ``change_log_order`` where the list is written."""
    return mapping.where(F.col("term") != F.col("canonical")).select(
        F.col("term").alias("original"),
        F.col("canonical").alias("mapped"),
        "group_size",
        "max_similarity",
    )


def change_log_order(changes: DataFrame, by: Literal["group_size", "vocabulary"] = "group_size") -> DataFrame:
    """Largest groups first for review, or plain vocabulary order."""
    if by == "vocabulary":
        return changes.orderBy("original")
    return changes.orderBy(F.desc("group_size"), F.asc("original"))


def mapping_sample(mapping: DataFrame, n: int = 1000) -> DataFrame:
    """The first ``n`` mapping rows in term order."""
    return mapping.select("term", "canonical").orderBy("term").limit(n)


def mapping_stats(mapping: DataFrame, threshold: float) -> DataFrame:
    """Vocabulary size, changed terms, their share and mean group size, and the threshold used."""
    changed = F.col("term") != F.col("canonical")
    return mapping.agg(
        F.count("term").alias("total"),
        F.count_if(changed).alias("changed"),
        F.try_divide(F.count_if(changed) * F.lit(100.0), F.count("term")).alias("changed_pct"),
        F.avg(F.when(changed, F.col("group_size"))).alias("mean_group_size"),
        F.lit(float(threshold)).alias("threshold"),
    )


def apply_mapping(log: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every log row with ``mapped_term``; a term without mapping keeps its own text.

    One hop only: a term mapped to b stays on b even if b maps on. Only terms that change are looked
    up. Spark broadcasts a small list of those; with a large one a hot term is split by the adaptive
    skew join, and rows without a term are dealt out under keys that match nothing.
    """
    changed = mapping.where(F.col("term") != F.col("canonical"))
    lookup = changed.select(F.col("term").alias("_key"), F.col("canonical").alias("_mapped"))
    spread = F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(NULL_KEYS)).cast("string"))
    joined = log.withColumn("_key", F.coalesce("term", spread)).join(lookup, "_key", "left")
    return joined.select(*(joined[f"`{c}`"] for c in log.columns), F.coalesce("_mapped", "term").alias("mapped_term"))


def mapped_best_rank(best: DataFrame, mapping: DataFrame) -> DataFrame:
    """Best ranks by canonical term, from the best ranks by term.

    A minimum of minima is the minimum, so this equals mapping every log row first. But only one row
    per (term, date) meets the mapping, and no hot term does.
    """
    return best_rank(apply_mapping(best, mapping), "mapped_term")
