"""Exact top-k inner products over vectors sorted by norm.

Vectors are cut into blocks by descending norm and turned by the singular vectors of the whole table,
so that the first coordinates carry most of a vector. A first pass over the block of the longest
vectors gives every query a score that its answers must reach. In every other block a query stops
where its norm times the block's cannot reach that score, and a candidate goes on only if the product
over the first coordinates plus the product of both remainders' norms (Cauchy-Schwarz) still can.
What is left is multiplied exactly, in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import rows_of, stored

#: Vectors of a candidate block and of a query block; candidates worked on at once.
BLOCK, QUERIES, STRIP = 4096, 1024, 512
#: Share of the squared length that the first coordinates should carry.
CARRIED = 0.6


def _sound(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine)


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id, q``: sound vectors with components ``floor(scale * x)``; the others take no part."""
    v = F.col(vector_col)
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.filter(F.col(id_col).isNotNull() & _sound(v)).select(F.col(id_col).cast("long").alias("id"), whole.alias("q"))


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all rows, the strongest first, from their sum of outer products."""

    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                m = rows_of(batch.column("q"), np.float64)
                total += m.T @ m
        index = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(total.ravel())], ["k", "x"])

    summed = rows.select("q").mapInArrow(partial, "k long, x double").groupBy("k").agg(F.sum("x").alias("x"))
    gram = np.zeros(width * width)
    for r in summed.collect():  # width * width numbers
        gram[r["k"]] = r["x"]
    values, turned = np.linalg.eigh(gram.reshape(width, width))
    return np.ascontiguousarray(turned[:, ::-1])


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, ids: np.ndarray, rows: np.ndarray,
    turn: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, candidate ids and scores of a block that may be among a query's best ``k``.

    ``floor`` holds the score each query has to reach; it rises as candidates come in.
    """
    floor = floor.astype(np.float64).copy()
    exact = queries.astype(np.float64), rows.astype(np.float64)
    long_q, long_c = (np.sqrt((m * m).sum(axis=1)) for m in exact)
    order = np.argsort(-long_c, kind="stable")
    ids, rows, long_c, exact = ids[order], rows[order], long_c[order], (exact[0], exact[1][order])
    turned_q, turned_c = exact[0] @ turn, exact[1] @ turn
    energy = np.cumsum((turned_c * turned_c).sum(axis=0))
    first = min(int(np.searchsorted(energy, CARRIED * energy[-1])) + 1, turn.shape[0]) if energy[-1] > 0 else 1
    rest_q, rest_c = (np.sqrt((m[:, first:] ** 2).sum(axis=1)) for m in (turned_q, turned_c))
    slack = 1e-9 * (long_q[:, None] + 1) * (long_c.max(initial=0) + 1)  # rounding of the bounds
    fits = float(long_q.max(initial=0)) * float(long_c.max(initial=0)) < 2.0**52
    out = []
    for at in range(0, len(ids), STRIP):
        to = min(at + STRIP, len(ids))
        alive = np.flatnonzero(long_q * long_c[at] + slack[:, 0] >= floor)
        if not len(alive):
            break  # later candidates are no longer
        bound = turned_q[alive, :first] @ turned_c[at:to, :first].T + rest_q[alive, None] * rest_c[None, at:to]
        may = bound + slack[alive] >= floor[alive, None]
        may &= query_ids[alive, None] != ids[None, at:to]
        if not may.any():
            continue
        if fits:
            score = np.rint(exact[0][alive] @ exact[1][at:to].T).astype(np.int64)
        else:
            score = queries[alive] @ rows[at:to].T
        may &= score >= np.where(np.isfinite(floor[alive]), floor[alive], -np.inf)[:, None]
        q, c = np.nonzero(may)
        out.append((alive[q], ids[at:to][c], score[q, c]))
        if to - at >= k:
            held = np.where(may, score.astype(np.float64), -np.inf)
            floor[alive] = np.maximum(floor[alive], -np.partition(-held, k - 1, axis=1)[:, k - 1])
    if not out:
        return (np.empty(0, np.int64),) * 3
    q, c, s = (np.concatenate(x) for x in zip(*out))
    best = np.lexsort((c, -s, q))
    q, c, s = q[best], c[best], s[best]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], c[place < k], s[place < k]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _pairs(queries: DataFrame, blocks: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """Best rows of every query block in every candidate block that it is dealt to."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], _FOUND)
        numbers = lambda t, c: t.column(c).to_numpy()
        q_ids = numbers(left, "id")
        q, c, s = search_block(
            q_ids, rows_of(left.column("q"), np.int64), numbers(left, "floor"),
            numbers(right, "id"), rows_of(right.column("q"), np.int64), turn, k,
        )
        return pa.table([q_ids[q], c, s], schema=_FOUND)

    return queries.groupBy("part", "block").cogroup(blocks.groupBy("part", "block")).applyInArrow(
        compare, "query_id long, vec_id long, score long"
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5,
    scale: float = 256.0,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of every ``every``-th vector.

    Components are floor(scale * x), scores exact. All vectors but those with the query's own id are
    candidates; ties go to the smaller id.

    * Vectors that are null, empty, or hold null or non-finite components, and null ids, take no part.
    * Vectors of different widths are compared as if zeros followed the shorter one.
    * Repeated rows are candidates each; as queries they count once. Fewer candidates give fewer ranks.
    * Without any query, or in an empty table, the result is empty. Scores must fit 64 bits.
    """
    spark = vectors.sparkSession
    rows = stored(quantized(vectors, id_col, vector_col, scale), "quantized")
    n, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q"))
    rows = rows.withColumn("q", F.concat("q", zeros))
    turn = rotation(rows, width)
    norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n_blocks = max(1, -(-n // BLOCK))
    # The borders are drawn by norm; ids among equal norms, so that a block never outgrows its share.
    blocks = rows.repartitionByRange(n_blocks, norm.desc(), F.col("id")).withColumn("block", F.spark_partition_id())
    blocks = stored(blocks, "blocks")
    queries = rows.filter(F.pmod("id", F.lit(every)) == 0).dropDuplicates()
    n_queries = queries.count()
    parts = max(1, -(-n_queries // QUERIES))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    queries = stored(queries, "queries")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    first = blocks.agg(F.min("block")).first()[0]
    head = _pairs(
        queries.withColumn("block", F.lit(first)).withColumn("floor", F.lit(float("-inf"))),
        blocks.filter(F.col("block") == first).withColumn("part", every_part), turn, k,
    )
    head = stored(_best(head, k), "head")
    floors = head.filter(F.col("rank") == k).groupBy("query_id").agg(F.max("score").cast("double").alias("floor"))
    queries = queries.join(floors, F.col("id") == F.col("query_id"), "left").drop("query_id")
    queries = queries.withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    # Numbers of blocks that hold rows; one small row each.
    numbers = [r[0] for r in blocks.filter(F.col("block") != first).select("block").distinct().collect()]
    if not numbers:
        return head.select("query_id", "rank", "vec_id", "score")
    low, high = min(numbers), max(numbers)
    dealt = queries.withColumn("block", F.explode(F.sequence(F.lit(low), F.lit(high))))
    rest = _pairs(dealt, blocks.filter(F.col("block") != first).withColumn("part", every_part), turn, k)
    return _best(head.select("query_id", "vec_id", "score").union(rest), k).select("query_id", "rank", "vec_id", "score")
