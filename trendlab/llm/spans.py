"""Spans of regular-expression matches, in SQL expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPAN = "array<struct<start:long,end:long,hit:string>>"


def located(df: DataFrame, text: str, out: str, pattern: str, when: Column | None = None) -> DataFrame:
    """``df`` with ``out``: the leftmost non-overlapping matches of ``pattern`` in the column ``text``.

    An array of ``start, end, hit`` in code points, end exclusive. Splitting a text at a pattern gives
    what lies between its matches, so the running sum of the lengths of gaps and matches places each
    match. ``when`` may rule rows out cheaply; they get an empty array.
    """
    hits, pieces = f"_{out}_hits", f"_{out}_pieces"
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    nothing = F.lit(None).cast("array<string>")
    df = df.withColumn(hits, F.when(when, found).otherwise(nothing) if when is not None else found)
    gaps = F.when(F.size(hits) > 0, F.split(F.col(text), pattern, -1))
    df = df.withColumn(pieces, F.arrays_zip(F.col(hits).alias("hit"), gaps.alias("gap")))

    def add(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))
    placed = F.aggregate(F.filter(pieces, lambda p: p["hit"].isNotNull()), begin, add)["spans"]
    return df.withColumn(out, F.coalesce(placed, F.array().cast(SPAN))).drop(hits, pieces)


def tagged(spans: Column, kind: str, place: int) -> Column:
    """The spans of one kind as ``start, place, end, kind``, which sorts as reports list them."""
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def digest(spans: Column, kinds: list[str]) -> Column:
    """SHA-256, lower-case hex, of the spans of ``kinds`` as ``joined`` writes them."""
    return F.sha2(joined(of_kinds(spans, kinds)), 256)
