"""Embedders: functions from a term column to a column of raw (not yet unit) vectors."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from trendlab.functions.arrays import bind

# Executors need not have this package installed: the model's UDF travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Embedder = Callable[[Column], Column]


def ngram_embedder(dim: int = 64) -> Embedder:
    """Hashed character-3-gram counts, computed by built-in expressions only.

    This measures spelling, not meaning. It needs no model and no Python worker, which makes it the
    default; plug a language model in with ``model_embedder``.
    """

    def bucket(gram: Column) -> Column:
        return F.conv(F.substring(F.md5(gram), 1, 4), 16, 10).cast("int") % dim

    def embed(term: Column) -> Column:
        padded = F.concat(F.lit(" "), term, F.lit(" "))
        starts = F.when(F.char_length(padded) >= 3, F.sequence(F.lit(1), F.char_length(padded) - 2))
        grams = F.transform(starts, lambda i: bucket(F.substr(padded, i, F.lit(3))))
        slots = F.sequence(F.lit(0), F.lit(dim - 1))
        counts = bind(
            F.coalesce(grams, F.array().cast("array<int>")),
            lambda g: F.transform(
                slots, lambda s: (F.size(g) - F.size(F.array_remove(g, s))).cast("double")
            ),
        )
        return F.when(term.isNotNull(), counts)

    return embed


def model_embedder(load: Callable[[], Any], batch_size: int = 64) -> Embedder:
    """Embedder around a model with ``encode(list[str]) -> array of shape (n, d)``.

    ``load`` runs once per Python task, not once per batch; terms reach the model in slices of
    ``batch_size``.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for terms in batches:
            vectors: list = []
            for start in range(0, len(terms), batch_size):
                vectors.extend(model.encode(terms.iloc[start:start + batch_size].tolist()))
            yield pd.Series(vectors, index=terms.index)

    return encode
