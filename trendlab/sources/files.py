"""What the report files look like before they are read as tables: encoding, header, defects.

One text pass gives a small row per file. The pass aggregates on the map side, so neither a huge
file nor a folder of many files is ever gathered in one place.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trendlab.functions import is_rank

# Executors need not have this package installed: the header UDF travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Java names of the encodings tried, in this order. GB2312 text is valid GBK.
UTF8, GBK = "UTF-8", "GBK"
# Fixed value: one valid character of GBK, as bytes read one character each.
_GBK_CHARACTER = r"[\x00-\x7f]|[\x81-\xfe][\x40-\x7e\x80-\xfe]"
_BOM = "\ufeff"


def list_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Names of all files of a folder. They come from Spark's own file listing, because a scan
    passes over empty files."""
    listed = spark.read.option("pathGlobFilter", glob).text(path).inputFiles()
    # The listing writes an empty authority as "file:///", row metadata as "file:/".
    names = [re.sub(r"^([a-z][a-z0-9+.-]*):///", r"\1:/", n) for n in listed]
    return spark.createDataFrame([(n,) for n in names], T.StructType([T.StructField("file", T.StringType())]))


def _is_gbk(line: Column) -> Column:
    """Whether the bytes of a line are GBK: nothing is left once its characters are taken out."""
    as_bytes = F.decode(line.cast("binary"), "ISO-8859-1")
    return ~as_bytes.rlike(r"[\x80-\xff]") | (F.regexp_replace(as_bytes, _GBK_CHARACTER, "") == "")


def _text_profile(spark: SparkSession, path: str, glob: str) -> DataFrame:
    lines = (
        spark.read.option("pathGlobFilter", glob)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            "value",
        )
    )
    encoding = F.when(F.bool_and(F.is_valid_utf8("value")), UTF8).when(F.bool_and(_is_gbk(F.col("value"))), GBK)
    return lines.groupBy("file").agg(
        encoding.alias("encoding"),
        F.min_by(F.col("value").cast("binary"), F.struct("block", "at")).alias("header"),
    )


def clean_names(names: Iterable[str]) -> list[str]:
    return [n.replace(_BOM, "").strip() for n in names]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _header_columns(encoding: pd.Series, header: pd.Series) -> pd.Series:
    """Column names from the first line of each file; null if it cannot be decoded after all."""

    def names(enc: str | None, line: bytes) -> list[str] | None:
        if enc is None:
            return None
        try:
            text = bytes(line).decode(enc)
        except UnicodeDecodeError:
            return None
        return clean_names(next(csv.reader([text]), []))

    return pd.Series([names(e, h) for e, h in zip(encoding, header)], dtype=object)


def inspect_files(
    spark: SparkSession, path: str, required: Iterable[str] = (), glob: str = "*.csv"
) -> DataFrame:
    """One row per file: ``file, empty, encoding, columns, missing``.

    ``encoding`` is null when no encoding fits; ``columns`` is null then, for an empty file, and
    where the header holds a code the encoding leaves unassigned.
    ``missing`` lists the required columns the header lacks. Header names are trimmed and free of
    a byte order mark.
    """
    known = _text_profile(spark, path, glob).select(
        "file", "encoding", _header_columns("encoding", "header").alias("columns"), F.lit(False).alias("empty")
    )
    wanted = F.array(*(F.lit(c) for c in required)).cast("array<string>")
    return (
        list_files(spark, path, glob)
        .join(known, "file", "left")
        .select(
            "file",
            F.coalesce("empty", F.lit(True)).alias("empty"),
            "encoding",
            "columns",
            F.when(F.col("columns").isNotNull(), F.array_except(wanted, "columns")).alias("missing"),
        )
    )


def detect_encoding(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """``file, encoding``: UTF-8 (with or without mark), else GBK, else null."""
    return inspect_files(spark, path, (), glob).select("file", "encoding")


def missing_columns(spark: SparkSession, path: str, required: Iterable[str], glob: str = "*.csv") -> DataFrame:
    """Files that lack required columns: ``file, missing``."""
    files = inspect_files(spark, path, required, glob)
    return files.where(F.size("missing") > 0).select("file", "missing")


def file_quality_report(log: DataFrame, files: DataFrame, required: Iterable[str]) -> DataFrame:
    """Files with a defect: ``file, reason, undated, unranked`` and which stages can use the file.

    ``log`` is what ``read_term_log`` returned and ``files`` what ``inspect_files`` returned, which
    also has the files that gave no row at all; ``required`` names the term, date and rank column.
    ``undated`` and ``unranked`` count rows with a term
    whose date or rank cannot be read. A file is good for the ``vocabulary`` if it has terms, for the
    ``mapped_log`` if it has dates as well, and for the ``matrix`` if it has all three columns;
    malformed rows make it unfit for all.
    """
    has_term = F.col("term").isNotNull()
    valid = F.col("term").isNotNull() & F.col("report_date").isNotNull() & is_rank(F.col("rank_raw"))
    counts = log.groupBy("file").agg(
        F.count_if(valid).alias("valid"),
        F.count_if("malformed").alias("malformed"),
        F.count_if(has_term & F.col("report_date").isNull()).alias("undated"),
        F.count_if(has_term & ~F.coalesce(is_rank(F.col("rank_raw")), F.lit(False))).alias("unranked"),
    )
    reason = (
        F.when(F.col("empty"), "empty file")
        .when(F.col("columns").isNull(), "no encoding fits")
        .when(F.size("missing") > 0, F.concat(F.lit("missing columns: "), F.array_join("missing", ", ")))
        .when(F.col("malformed") > 0, F.concat(F.lit("malformed rows: "), F.col("malformed")))
        .when(F.coalesce("valid", F.lit(0)) == 0, "no valid data")
    )
    sound = F.col("columns").isNotNull() & ~F.col("empty") & (F.coalesce("malformed", F.lit(0)) == 0)
    lacks = F.size("missing")
    term, date, _ = required
    has_terms = ~F.array_contains("missing", term)
    has_dates = has_terms & ~F.array_contains("missing", date)
    return (
        files.join(counts, "file", "left")
        .select(
            "file",
            reason.alias("reason"),
            F.coalesce("undated", F.lit(0)).alias("undated"),
            F.coalesce("unranked", F.lit(0)).alias("unranked"),
            F.coalesce(sound & has_terms, F.lit(False)).alias("vocabulary"),
            F.coalesce(sound & has_dates, F.lit(False)).alias("mapped_log"),
            F.coalesce(sound & (lacks == 0), F.lit(False)).alias("matrix"),
        )
        .where(F.col("reason").isNotNull() | (F.col("undated") > 0) | (F.col("unranked") > 0))
    )


def accepted(log: DataFrame, report: DataFrame, stage: str = "matrix") -> DataFrame:
    """The log without the files that are unfit for a stage: ``vocabulary``, ``mapped_log``, ``matrix``."""
    return log.join(report.where(~F.col(stage)).select("file"), "file", "left_anti").select(*log.columns)


def run_summary(report: DataFrame, files: DataFrame) -> DataFrame:
    """Number of files without a reason against them and of all files: ``ok, total``."""
    skipped = report.agg(F.count("reason")).scalar()
    return files.agg(F.count(F.lit(1)).alias("total")).select((F.col("total") - skipped).alias("ok"), "total")
