"""Stored results. Everything large is Parquet; review lists can be CSV, statistics are JSON."""

from __future__ import annotations

from typing import Literal, NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from trendlab.operators import mapping as m, recommend
from trendlab.operators.matrix import cells


class Matrix(NamedTuple):
    curves: DataFrame
    long: DataFrame
    terms: DataFrame
    dates: DataFrame


def write_mapped(df: DataFrame, path: str, fmt: Literal["parquet", "csv"] = "parquet") -> None:
    """The mapped log, one folder per report date.

    Rebalancing gathers a date into few files, but splits a date that holds much of the log.
    """
    writer = df.hint("rebalance", "report_date").write.mode("overwrite").partitionBy("report_date")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_change_log(
    changes: DataFrame, path: str, by: Literal["group_size", "vocabulary"] = "group_size",
    fmt: Literal["parquet", "csv"] = "csv",
) -> None:
    m.change_log_order(changes, by).write.mode("overwrite").option("header", True).format(fmt).save(path)


def write_mapping_sample(mapping: DataFrame, path: str, n: int = 1000) -> None:
    m.mapping_sample(mapping, n).write.mode("overwrite").json(path)


def write_matrix(curves: DataFrame, dates: DataFrame, path: str) -> Matrix:
    """Curves, long cells, terms and dates as four tables; terms and cells follow the stored curves.

    Curves are stored in term order, so that a scan for one term skips the files and row groups of
    the others.
    """
    spark = curves.sparkSession
    dates.orderBy("report_date").write.mode("overwrite").parquet(f"{path}/dates")
    curves.orderBy("term").write.mode("overwrite").parquet(f"{path}/trend_curve")
    stored = spark.read.parquet(f"{path}/trend_curve")
    axis = spark.read.parquet(f"{path}/dates")
    stored.select("term").write.mode("overwrite").parquet(f"{path}/terms")
    cells(stored, axis).write.mode("overwrite").parquet(f"{path}/trend_long")
    return read_matrix(spark, path)


def read_matrix(spark: SparkSession, path: str) -> Matrix:
    return Matrix(*(spark.read.parquet(f"{path}/{t}") for t in ("trend_curve", "trend_long", "terms", "dates")))


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("term", "vector").orderBy("term").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_features(spark: SparkSession, matrix_path: str, vectors_path: str | None = None) -> DataFrame:
    """Stored curves with their vectors. Without vectors the column is null and searches by
    meaning find nothing."""
    curves = read_matrix(spark, matrix_path).curves
    if vectors_path is None:
        return curves.select("term", F.lit(None).cast("array<float>").alias("vector"), "curve")
    return recommend.load_features(curves, read_vectors(spark, vectors_path))
