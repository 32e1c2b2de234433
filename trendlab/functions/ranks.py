"""Rank and date text, and the log scale ranks are analysed on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from trendlab.functions.dates import read_time

# Spark's cast also takes Java literals such as "1d" and "NaN"; only plain numbers are ranks.
_NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity)\s*$"


def _digits(c: Column) -> Column:
    return F.replace(c.cast("string"), F.lit(","), F.lit(""))


def is_rank(c: Column) -> Column:
    """Whether ``parse_rank`` gives a value. As a filter this is cheaper than parsing twice."""
    return _digits(c).rlike(_NUMBER)


def rank_value(c: Column) -> Column:
    """The number in a text known to hold a rank."""
    return _digits(c).try_cast("double")


def parse_rank(c: Column) -> Column:
    """Rank text with thousands separators to DOUBLE; text that is no number becomes null."""
    return F.when(is_rank(c), rank_value(c))


def parse_date(c: Column, formats: Iterable[str] = (), day_first: Column | bool = False,
               dot_day_first: Column | bool = True) -> Column:
    """Date text to DATE: ``formats`` first, then the layouts of ``trendlab.functions.dates``; else null.

    A time of day is cut off, see ``parse_time``. Months may be written out. In ``a/b/yyyy`` the
    month comes first unless ``day_first`` (a column, e.g. a file's vote, or a constant) says otherwise;
    in ``a.b.yyyy`` the day, unless ``dot_day_first`` is false.
    """
    return read_time(c, tuple(formats), day_first, dot_day_first).cast("date")


def parse_time(c: Column, formats: Iterable[str] = (), day_first: Column | bool = False,
               dot_day_first: Column | bool = True) -> Column:
    """The texts ``parse_date`` reads to TIMESTAMP_NTZ with their time of day, midnight where there is none.

    The written time is kept: a zone after it is ignored, AM/PM is applied, and no session zone
    takes part, so a time that a summer-time change skips stays as written.
    """
    return read_time(c, tuple(formats), day_first, dot_day_first)


def has_time(c: Column) -> Column:
    """Whether a timestamp is not a midnight."""
    return c != c.cast("date").cast("timestamp_ntz")


def log_rank(rank: Column) -> Column:
    return F.log10(rank + F.lit(1))


def inverse_rank(value: Column) -> Column:
    """Rank from its log value. Exact only up to rounding, e.g. 1999999.9999999993."""
    return F.pow(F.lit(10.0), value) - F.lit(1)
