"""Arithmetic on vectors and curves held as arrays, evaluated in the JVM in DOUBLE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, with ``value`` computed once per row.

    A column used inside a lambda is evaluated again for each array element; binding it as the
    variable of an outer one-element lambda avoids that.
    """
    return F.transform(F.array(value), body).getItem(0)


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + term(x))


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y), lambda p: p)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(_doubles(v), lambda x: x * x))


def mean(v: Column) -> Column:
    return F.try_divide(_sum(_doubles(v), lambda x: x), F.size(v))


def l2_normalize(v: Column) -> Column:
    """Vector scaled to length one; null for a zero vector."""
    return bind(norm(v), lambda n: F.when(n > 0, F.transform(_doubles(v), lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    """Dot product, i.e. the cosine when both vectors have length one."""
    return _dot(_doubles(a), _doubles(b))


def centred(v: Column) -> Column:
    return bind(mean(v), lambda m: F.transform(_doubles(v), lambda x: x - m))


def pearson_to(curve: Column, target: Column, target_norm: Column) -> Column:
    """Correlation of ``curve`` with a target given as its centred values and their norm.

    A constant curve on either side correlates 0. It is recognised by its extremes, because the
    rounding of a mean leaves residues that would otherwise pass for variance.
    """
    flat = (F.array_max(curve) == F.array_min(curve)) | (F.array_max(target) == F.array_min(target))
    corr = bind(centred(curve), lambda c: F.try_divide(_dot(c, target), norm(c) * target_norm))
    return F.when(flat, F.lit(0.0)).otherwise(corr)


def pearson(a: Column, b: Column) -> Column:
    flat = F.array_max(b) == F.array_min(b)
    corr = bind(centred(b), lambda c: pearson_to(a, c, norm(c)))
    return F.when(flat, F.lit(0.0)).otherwise(corr)
