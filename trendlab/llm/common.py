"""Helpers the operators share: stored steps, connected components, broadcast by checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: What a broadcast may hold at most; the row counts are measured before a side is broadcast.
BROADCAST_BYTES = 32 << 20
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing in a local session a new temporary folder is used, which is right
    only because driver and executors are then one process; off local mode that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="trendlab-llm-"))
        base = _OWN[0]
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage for good."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows it, else as it is.

    ``df`` should be stored already, as its rows are counted here.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``node, root`` for every node of an edge.

    ``root`` is the smallest node of the component. Alternating large-star and small-star steps, in
    which every node passes on its smallest neighbour: an aggregation and a join each, so a node with
    very many neighbours is never gathered in one place. Each round is stored. Edges with a null end
    and loops link nothing.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(
        edges.filter(a != b).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    while mark != (mark := _fingerprint(edges)):
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b"))
        large = large.filter(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(low, "a").select(b.alias("a"), F.col("m").alias("b")).filter(a != b)
        edges = stored(small_star.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return edges.select(a.alias("node"), b.alias("root")).union(
        edges.select(b.alias("node"), b.alias("root")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("a"), F.expr("bit_xor(xxhash64(a, b))")).first())


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each run of equal ``by`` (integers), across the borders of batches."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in by], axis=1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(keys[a].tolist())
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def rows_of(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """A list column whose rows are all of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(len(column), -1)
