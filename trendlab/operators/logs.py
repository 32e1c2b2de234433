"""Cleaning a term log and reducing it to vocabulary and best ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trendlab.functions import char_count, is_rank, parse_rank, rank_value


def clean_log(log: DataFrame, keep_empty_dates: bool = False, term_col: str = "term") -> DataFrame:
    """Parse ``rank_raw`` into ``rank`` and drop unusable rows.

    By default a row needs a term, a date and a rank. ``keep_empty_dates`` keeps rows whose rank is
    bad, so that a date with only bad ranks stays an axis date; their rank is null.
    """
    dated = log.where(F.col(term_col).isNotNull() & F.col("report_date").isNotNull())
    text = F.col("rank_raw")
    if keep_empty_dates:
        return dated.withColumn("rank", parse_rank(text)).drop("rank_raw")
    return dated.where(is_rank(text)).withColumn("rank", rank_value(text)).drop("rank_raw")


def build_vocab(log: DataFrame) -> DataFrame:
    """Distinct terms of a log. Order is not part of a DataFrame: sort where it is written."""
    return log.select("term").where(F.col("term").isNotNull()).distinct()


def vocab_stats(vocab: DataFrame) -> DataFrame:
    """Size of the vocabulary and mean length of its terms."""
    return vocab.agg(F.count("term").alias("terms"), F.avg(char_count(F.col("term"))).alias("mean_length"))


def best_rank(log: DataFrame, term_col: str = "term") -> DataFrame:
    """Smallest rank by term and date, whichever files the rows came from.

    ``min`` combines on the map side, so a term or date holding a third of the log reaches the
    shuffle as one row per map task.
    """
    return (
        log.where(F.col(term_col).isNotNull() & F.col("report_date").isNotNull())
        .groupBy(F.col(term_col).alias("term"), "report_date")
        .agg(F.min("rank").alias("rank"))
    )


def log_best_rank(log: DataFrame, keep_empty_dates: bool = False, term_col: str = "term") -> DataFrame:
    """``best_rank(clean_log(log, keep_empty_dates))``, parsing each row once.

    ``min`` skips bad ranks by itself, so cells without any valid rank are dropped after the
    aggregation. A filter before it would parse every rank a second time.
    """
    best = best_rank(log.withColumn("rank", parse_rank(F.col("rank_raw"))), term_col)
    return best if keep_empty_dates else best.where(F.col("rank").isNotNull())
