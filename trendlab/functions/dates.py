"""Dates and times of reports, read by one pattern per row and a layout chosen per file.

Every layout the reader knows is one branch of a single pattern; one ``regexp_replace`` per row turns
a date text into its parts (year, month or month name, day or the two ambiguous numbers of
``a/b/yyyy``, hour, minute, second, fraction, AM/PM). Values are built with
``try_make_timestamp_ntz``, so no session zone takes part; a zone written after a time is ignored
and the written time kept. Whether ``a/b/yyyy`` is month or day first is one decision per file and
separator: a vote over all its dates (``layout_votes``) leaves the default (month first for ``/``
and ``-``, day first for ``.``) only where it cannot read every one of them and the other reading
can; where both can and some date differs, the default stands and the file is reported ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trendlab.functions.arrays import bind

# English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_SEP = "\u0001"
_NAME = r"[A-Za-z]{3,9}\.?"
_BRANCHES = (
    r"(?<y1>\d{4})[-/.](?<m1>\d{1,2})[-/.](?<d1>\d{1,2})",
    r"(?<y2>\d{4})(?<m2>\d{2})(?<d2>\d{2})",
    r"(?<y3>\d{4})\s*年\s*(?<m3>\d{1,2})\s*月\s*(?<d3>\d{1,2})\s*日",
    r"(?<a4>\d{1,2})(?<p4>[-/.])(?<b4>\d{1,2})[-/.](?<y4>\d{4})",
    rf"(?<n5>{_NAME})\s+(?<d5>\d{{1,2}}),?\s+(?<y5>\d{{4}})",
    rf"(?<d6>\d{{1,2}})\s+(?<n6>{_NAME}),?\s+(?<y6>\d{{4}})",
)
_TIME = (
    r"(?:(?:\s*T\s*|\s+)(?<h>\d{1,2})[:时時點点](?<mi>\d{2})(?:[:分](?<s>\d{2})(?:[.,](?<f>\d{1,9}))?)?秒?"
    r"\s*(?<ap>[AaPp]\.?[Mm]\.?)?)?"
    r"\s*(?:Z|[+-]\d{2}(?::?\d{2})?|UTC|GMT)?"
)
# Words after a date that start with no digit ("late", "(Mon)") are ignored; digits must be a time.
PATTERN = rf"^\s*(?:{'|'.join(_BRANCHES)}){_TIME}(?:\s+[^\d\s].*)?\s*$"
_PARTS = {
    "y": "${y1}${y2}${y3}${y4}${y5}${y6}", "m": "${m1}${m2}${m3}", "n": "${n5}${n6}",
    "d": "${d1}${d2}${d3}${d5}${d6}", "a": "${a4}", "b": "${b4}", "p": "${p4}", "h": "${h}", "mi": "${mi}", "s": "${s}",
    "f": "${f}", "ap": "${ap}",
}


def date_parts(c: Column) -> Column:
    """A struct of the parts of a date text (all strings, empty where absent); null if no layout fits."""
    text = c.cast("string")
    out = F.regexp_replace(text, PATTERN, "\u0002" + _SEP.join(_PARTS.values()))

    def fields(parts: Column) -> Column:
        fits = F.startswith(parts[0], F.lit("\u0002"))
        return F.struct(*[
            F.when(fits, F.get(parts, F.lit(i)) if i else F.replace(parts[0], F.lit("\u0002"), F.lit(""))).alias(k)
            for i, k in enumerate(_PARTS)])

    return bind(F.split(out, _SEP), fields)


def _number(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _first(p: Column, day_first: Column, dot_day_first: Column) -> Column:
    return F.when(p["p"] == ".", dot_day_first).otherwise(day_first)


def _month(p: Column, day_first: Column) -> Column:
    name = F.lower(F.substring(p["n"], 1, 3))
    by_name = F.coalesce(*[F.when(name == m, F.lit(i + 1)) for i, m in enumerate(MONTHS)])
    ambiguous = F.when(day_first, _number(p["b"])).otherwise(_number(p["a"]))
    return F.coalesce(_number(p["m"]), F.when(p["n"] != "", by_name), ambiguous)


def _day(p: Column, day_first: Column) -> Column:
    ambiguous = F.when(day_first, _number(p["a"])).otherwise(_number(p["b"]))
    return F.coalesce(_number(p["d"]), ambiguous)


def _lit(x: Column | bool) -> Column:
    return F.lit(x) if isinstance(x, bool) else x


def time_of(p: Column, day_first: Column | bool = False, dot_day_first: Column | bool = True) -> Column:
    """TIMESTAMP_NTZ from ``date_parts``; midnight without a time, null if a part is out of range.

    ``a/b/yyyy`` and ``a-b-yyyy`` are month first unless ``day_first``; ``a.b.yyyy`` is day first
    unless ``dot_day_first`` is false. The parts are computed once per row, see ``bind``.
    """
    return bind(p, lambda parts: _time_of(parts, day_first, dot_day_first))


def _time_of(p: Column, day_first: Column | bool, dot_day_first: Column | bool) -> Column:
    first = _first(p, _lit(day_first), _lit(dot_day_first))
    hour = F.coalesce(_number(p["h"]), F.lit(0))
    ap = F.lower(F.substring(p["ap"], 1, 1))
    # 12 AM is midnight, 12 PM noon; an hour over 12 with AM/PM is no time.
    hour = (F.when(ap == "", hour)
            .when((hour >= 1) & (hour <= 12), hour % 12 + F.when(ap == "p", 12).otherwise(0)))
    frac = F.when(p["f"] != "", F.concat(F.lit("0."), p["f"]).cast("decimal(10,9)")).otherwise(F.lit(0).cast("decimal(10,9)"))
    sec = (F.coalesce(_number(p["s"]), F.lit(0)).cast("decimal(12,9)") + frac).cast("decimal(16,6)")
    return F.try_make_timestamp_ntz(_number(p["y"]), _month(p, first), _day(p, first), hour,
                                    F.coalesce(_number(p["mi"]), F.lit(0)), sec)


def read_time(c: Column, formats=(), day_first: Column | bool = False, dot_day_first: Column | bool = True) -> Column:
    """Date text to TIMESTAMP_NTZ: ``formats`` first (Spark patterns, read without a zone), then the
    known layouts; text that none reads becomes null."""
    text = F.trim(c.cast("string"))
    own = [F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz") for fmt in formats]
    known = time_of(date_parts(text), day_first, dot_day_first)
    return F.coalesce(*own, known) if own else known


def layout_votes(log: DataFrame, date: str = "report_date", file: str = "file") -> DataFrame:
    """One row per file with ``a?b?yyyy`` dates: ``day_first``, ``dot_day_first``, ``ambiguous``.

    Per separator (slash or dash; dot) a file keeps the default reading (month first; day first)
    unless it fails on one of its dates and the other reads them all. ``ambiguous``: for some
    separator both readings read every date and some date differs between them, so the default was
    taken without evidence. Rows of other layouts do not vote.
    """
    p = date_parts(F.trim(F.col(date)))
    shaped = log.select(F.col(file).alias("file"), p.alias("p")).where(F.col("p")["a"] != "")
    dot = F.col("p")["p"] == "."
    mdy = time_of(F.col("p"), False, False).isNotNull()
    dmy = time_of(F.col("p"), True, True).isNotNull()
    differs = F.col("p")["a"] != F.col("p")["b"]

    def every(cond: Column, of: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(of, cond)), F.lit(True))

    votes = shaped.groupBy("file").agg(
        every(mdy, ~dot).alias("s_mdy"), every(dmy, ~dot).alias("s_dmy"),
        every(mdy, dot).alias("d_mdy"), every(dmy, dot).alias("d_dmy"),
        F.coalesce(F.bool_or(differs & mdy & dmy & ~dot), F.lit(False)).alias("s_diff"),
        F.coalesce(F.bool_or(differs & mdy & dmy & dot), F.lit(False)).alias("d_diff"))
    return votes.select(
        "file", (~F.col("s_mdy") & F.col("s_dmy")).alias("day_first"),
        (~(~F.col("d_dmy") & F.col("d_mdy"))).alias("dot_day_first"),
        ((F.col("s_diff") & F.col("s_mdy") & F.col("s_dmy"))
         | (F.col("d_diff") & F.col("d_mdy") & F.col("d_dmy"))).alias("ambiguous"))
