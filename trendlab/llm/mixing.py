"""Mixing sources to target weights by repetition rates.

Sizes are summed per source, targets are filled up by weight, and a source's repetition rate is
target / size. Every document is taken floor(rate) times, plus once more if a uniform number hashed
from its id and a seed is below the fraction. Each source takes, of ``SEEDS`` numbered seeds, the one
whose copies come nearest its target; the trials are columns of one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import small, stored

#: Fixed values of the contract: weights in source order, share of all sizes, most copies.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEEDS = 32
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows.

    Weights go round in code-point order of the sources, null last. A source stops at ``most`` times
    its size; what it leaves is shared by weight among the others. Filling up in order of
    size / weight finds all that stop in one pass: source i stops if the share per weight that is
    left when all before it have stopped is at least its own limit per weight. The windows run over
    one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    per = per.withColumn("weight", F.array(*map(F.lit, weights))[place].cast("double"))
    per = per.withColumn("limit", (most * F.col("source_size")).cast("double"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left)
    per = per.withColumn("stops", F.col("level") >= F.col("limit") / F.col("weight"))
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)
    target = F.when(F.col("stops"), F.col("limit")).otherwise(F.col("weight") * level["level"])
    return per.select("source", "source_size", target.alias("target"))


def _uniform(seed: Column | int) -> Column:
    """A number in [0, 1) from the row's id and a seed, alike in every run."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.shiftrightunsigned(F.xxhash64("id", seed), 11) / F.lit(float(1 << 53))


def rates(sized: DataFrame, **targets) -> DataFrame:
    """One stored row per source of ``id, source, size``: ``source_size, target, whole, part, seed``."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = source_targets(sized, **targets).withColumn("rate", rate)
    per = stored(per.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole")), "targets")
    tried = _with_rates(sized, per).groupBy("source").agg(*(
        F.sum(F.col("size") * _copies(s)).alias(f"taken_{s}") for s in range(SEEDS)
    ))
    tried = per.join(tried.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    best = F.array_min(F.array(*(
        F.struct(F.abs(F.col(f"taken_{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)
    )))["seed"]
    return stored(tried.select(*per.columns, best.alias("seed")), "rates")


def _copies(seed: Column | int) -> Column:
    return F.col("whole") + (_uniform(seed) < F.col("part")).cast("long")


def _with_rates(rows: DataFrame, per: DataFrame) -> DataFrame:
    per = small(per, 256).withColumnRenamed("source", "of")
    return rows.join(per, rows["source"].eqNullSafe(per["of"])).drop("of")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return stored(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")),
        "sizes",
    )


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets
) -> DataFrame:
    """``id, size, source, source_size, target, copies`` for every row of ``docs``.

    * Null text: size 0. Null source: a source of its own, last. A source without words: target 0.
    * Repeated rows have one id and so are taken equally often; null ids share one number.
    * An empty table gives an empty result; other columns are not read.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    return _with_rates(sized, rates(sized, **targets)).select(
        "id", "size", "source", "source_size", "target", _copies(F.col("seed")).alias("copies")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as they are.

    How often follows from a row's id and its source's rate and seed, so only the table of sources
    meets the texts. Edge cases as in ``copies``.
    """
    per = rates(_sized(docs, id_col, text_col, source_col), **targets)
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id"), docs[source_col].alias("source"))
    times = F.expr("sequence(1, cast(copies as int))")
    taken = _with_rates(packed, per).withColumn("copies", _copies(F.col("seed"))).filter("copies > 0")
    return taken.select("row", F.explode(times)).select("row.*")
