"""Splitting and measuring term text. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: every code point that counts as white space when a term is split into words.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def words(c: Column) -> Column:
    """Words of a text, in order; never an empty string among them."""
    return F.filter(F.split(c, WHITESPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def char_count(c: Column) -> Column:
    return F.char_length(c)


def tokens(c: Column, min_len: int = 3) -> Column:
    """Lower-case words of at least ``min_len`` characters, duplicates kept."""
    return F.filter(F.split(F.lower(c), WHITESPACE), lambda w: F.char_length(w) >= min_len)
