"""Reading a folder of rank reports as one term log."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trendlab.functions import parse_date, parse_time
from trendlab.functions.dates import layout_votes
from trendlab.sources.files import GBK, inspect_files

# Fixed value: texts a pandas reader takes for missing by default. Some are real search terms, so
# ``read_term_log`` keeps them unless asked.
PANDAS_NA = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_CORRUPT = "_corrupt"
# Names the log gives to columns of its own; a report's column of such a name gets a number.
_OWN = ("term", "report_date", "rank_raw", "file", "malformed")
_DAY_FIRST, _DOT = "__day_first_of_file", "__dot_day_first_of_file"


@dataclass(frozen=True)
class LogColumns:
    """Header names of the three columns every report has (fixed values of the source format)."""

    term: str = "normalized_term"
    report_date: str = "报告日期"
    rank: str = "搜索频率排名"

    def required(self) -> tuple[str, str, str]:
        return self.term, self.report_date, self.rank


def column_names(header: list[str], cols: LogColumns) -> list[str]:
    """What each header name is called in the log: fixed names for the three known columns, other names
    as they are, numbered where one is taken, and by place where one is empty."""
    fixed = {cols.term: "term", cols.report_date: "report_date", cols.rank: "rank_raw"}
    taken, out = {n.lower() for n in _OWN}, []
    for place, name in enumerate(header):
        if name in fixed:
            out.append(fixed.pop(name))
            continue
        wanted, number = name or f"column_{place + 1}", 1
        new = wanted
        while new.lower() in taken:
            number += 1
            new = f"{wanted}_{number}"
        taken.add(new.lower())
        out.append(new)
    return out


def _read_group(
    spark: SparkSession, files: list[str], encoding: str, header: list[str], cols: LogColumns, multi_line: bool
) -> DataFrame:
    if encoding == GBK and spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        raise ValueError("GBK reports need spark.sql.legacy.javaCharsets=true, which get_session sets")
    # Columns are read by place, so names may clash or repeat.
    places = [f"_c{i}" for i in range(len(header))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*places, _CORRUPT]])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .csv([unquote(f) for f in files])
    )
    # A row with too few fields ends in nulls and is fine; one that fills the last column and is
    # still marked has too many.
    malformed = F.col(_CORRUPT).isNotNull() & F.col(places[-1]).isNotNull()
    named = [F.col(p).alias(n) for p, n in zip(places, column_names(header, cols))]
    return raw.select(*named, F.col("_metadata.file_path").alias("file"), malformed.alias("malformed"))


def read_term_log(
    spark: SparkSession,
    path: str,
    cols: LogColumns = LogColumns(),
    na_values: Iterable[str] | None = None,
    glob: str = "*.csv",
    multi_line: bool = False,
    files: DataFrame | None = None,
    date_formats: Iterable[str] = (),
    time_axis: bool = False,
    day_first: bool | DataFrame | None = None,
) -> DataFrame:
    """All reports of a folder: ``term, report_date DATE, rank_raw STRING``, other columns, ``file, malformed``.

    Every column is read as text, so types cannot differ between files. Files are read together
    where encoding and header agree, since one CSV scan takes one header; their columns are matched
    by name, and names that clash are numbered. A file needs a term column; without date or rank
    column these are null, and later stages leave its rows out. Files without terms, or that no
    encoding fits, give no rows: see ``file_quality_report``. ``files`` takes a stored
    ``inspect_files`` result and saves its pass over the text. ``na_values`` lists texts to read as
    missing; by default only an empty field is. ``date_formats`` are tried before the common layouts.
    ``time_axis`` makes ``report_date`` a TIMESTAMP_NTZ that keeps times of day apart. Whether
    ``a/b/yyyy`` (and ``a.b.yyyy``) is day or month first is decided per file: by a vote over its
    dates (``None``, one more pass over the date column), by a stored vote (``date_layouts``), or for
    all files (a bool; dotted dates are then day first).
    """
    log = _text_log(spark, path, cols, na_values, glob, multi_line, files)
    parse = parse_time if time_axis else parse_date
    order = log.columns
    if isinstance(day_first, bool):
        first, dot = F.lit(day_first), F.lit(True)
    else:
        votes = layout_votes(log) if day_first is None else day_first
        log = log.join(votes.select("file", F.col("day_first").alias(_DAY_FIRST), F.col("dot_day_first").alias(_DOT)),
                       "file", "left")
        first, dot = F.coalesce(F.col(_DAY_FIRST), F.lit(False)), F.coalesce(F.col(_DOT), F.lit(True))
    log = log.withColumn("report_date", parse(F.col("report_date"), date_formats, first, dot))
    return log.select(*(F.col(f"`{c}`") for c in order))


def date_layouts(spark: SparkSession, path: str, cols: LogColumns = LogColumns(), glob: str = "*.csv",
                 multi_line: bool = False, files: DataFrame | None = None) -> DataFrame:
    """Per file with dates of the form ``a/b/yyyy``: ``file, day_first, ambiguous`` (see ``layout_votes``)."""
    return layout_votes(_text_log(spark, path, cols, None, glob, multi_line, files))


def _text_log(spark, path, cols, na_values, glob, multi_line, files) -> DataFrame:
    """The log with ``report_date`` as written."""
    inspected = inspect_files(spark, path, cols.required(), glob) if files is None else files
    usable = inspected.where(F.array_contains("columns", cols.term))
    groups = usable.groupBy("encoding", "columns").agg(F.collect_list("file").alias("files")).collect()
    if not groups:
        raise ValueError(f"no report under {path} has the column {cols.term!r}")
    parts = [_read_group(spark, g.files, g.encoding, list(g.columns), cols, multi_line) for g in groups]
    log = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    absent = {c: F.lit(None).cast("string") for c in ("report_date", "rank_raw") if c not in log.columns}
    log = log.withColumns(absent) if absent else log
    if na_values is not None:
        texts = list(na_values)
        names = [n for n in log.columns if n not in ("file", "malformed")]
        log = log.withColumns({n: F.when(~F.col(f"`{n}`").isin(texts), F.col(f"`{n}`")) for n in names})
    first = ["term", "report_date", "rank_raw"]
    return log.select(*first, *(F.col(f"`{c}`") for c in log.columns if c not in first))
