"""A term log and vectors derived from the test tables, for queries, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# In all three test data sizes this term exists and keeps its place in the matrix.
SEED = "blue ring brand#25 promo"
# The test ranks lie between 18,000 and 2.1 million; with this cap the term filter bites.
TERM_CAP = 100_000
# Vectors of the embeddings table are nearly orthogonal; no pair reaches the default thresholds.
EMBEDDING_THRESHOLD = 0.35


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def term_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as one report row: a term, a weekly report date and a rank as text.

    Ranks carry thousands separators; some are text, and some rows have no date.
    """
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(" ", "p_name", F.lower("p_brand"), F.lower("p_type")).alias("term")
    )
    undated = (F.col("l_linenumber") == 7) & (F.col("l_tax") == 0)
    unranked = (F.col("l_returnflag") == "R") & (F.col("l_discount") == 0)
    day = F.col("l_shipdate").cast("date")
    week = F.date_sub(day, F.weekday(day))
    rank = F.floor(F.col("l_extendedprice") * 20)
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "term",
            F.when(~undated, week).alias("report_date"),
            F.when(unranked, "n/a").otherwise(F.format_number(rank, 0)).alias("rank_raw"),
            "l_orderkey",
            "l_linenumber",
        )
    )


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("term"), F.col("embedding").alias("vector")
    )
