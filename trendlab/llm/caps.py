"""Near-duplicate vectors by spherical caps of a structured random product code.

Directions are concatenations of random unit vectors, one from the code of each segment of the
coordinates; their number is the product of the codes' sizes, but decoding a vector needs only its
products with each code. List decoding extends partial sums segment by segment and drops those that
the best codewords of the remaining segments cannot lift over the threshold, and so finds every
direction whose cap holds the vector. Vectors meet in the caps they share and are compared exactly.

A pair that shares several caps counts in the smallest of them alone. Equal vectors are one node.
Large caps are compared block by block; what leaves a task is a count and an edge per vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, rows_of, runs, small, stored
from .minhash import common_counts
from .topk import _sound

#: Mean number of vectors in a cap, and of caps that a pair at the threshold should share.
CAP, SHARED = 256, 16
#: Vectors of a block of a large cap.
BLOCK = 2048


class Code(NamedTuple):
    width: int
    rotation: np.ndarray
    books: list[np.ndarray]  # per segment: codewords x coordinates
    threshold: float
    #: Caps that a vector is decoded to at least; it lowers its own threshold until there are as many.
    least: int


def make_code(width: int, n: int, cosine: float, seed: int = 5) -> Code:
    """A code for about ``n`` vectors: caps of ``CAP`` vectors on average, many enough for the recall.

    A cap holds the share ``CAP / n`` of the sphere. Given that one of two vectors at the threshold
    lies in it, the other does with probability ``p``; so each vector is decoded to ``SHARED / p`` caps.
    """
    rng = np.random.default_rng(seed)
    normal = NormalDist()
    share = min(0.02, max(CAP / max(n, 1), 1e-9))
    tau = -normal.inv_cdf(share)
    lean = (1 - cosine**2) ** 0.5
    grid = np.linspace(tau, tau + 4, 400)
    density = np.exp(-(grid**2) / 2)
    p = sum(d * normal.cdf((cosine * x - tau) / lean) for d, x in zip(density, grid)) / density.sum()
    directions = SHARED / p / share
    segments = 1
    while directions ** (1 / segments) > 256 and segments < width:
        segments += 1
    segments = max(segments, min(2, width))
    size = max(2, int(np.ceil(directions ** (1 / segments))))
    edges = np.linspace(0, width, segments + 1).astype(int)
    books = []
    for a, b in zip(edges[:-1], edges[1:]):
        book = rng.normal(size=(size, b - a))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / segments**0.5)
    rotation, _ = np.linalg.qr(rng.normal(size=(width, width)))
    # The threshold at which random directions hold the wanted share of random vectors.
    trial = rng.normal(size=(2000, width))
    trial /= np.linalg.norm(trial, axis=1, keepdims=True)
    picks = [book[rng.integers(0, size, 4000)] for book in books]
    products = sum(trial[:, a:b] @ pick.T for a, b, pick in zip(edges[:-1], edges[1:], picks))
    threshold = float(np.quantile(products, 1 - share)) if share > 1e-5 else tau / width**0.5
    return Code(width, rotation, books, threshold, min(int(np.ceil(SHARED / p)), size**segments))


def list_decode(code: Code, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, caps)``: every direction whose product with a unit vector reaches the vector's threshold.

    That is the code's, or a lower one where it would give fewer than ``code.least`` caps: a structured
    code covers some places of the sphere less than others, and neighbours there need as many caps.
    """
    turned = units @ code.rotation
    at, products = 0, []
    for book in code.books:
        products.append(turned[:, at : at + book.shape[1]] @ book.T)
        at += book.shape[1]
    threshold = np.full(len(units), code.threshold)
    todo, found = np.arange(len(units)), []
    while len(todo):
        rows, caps = _exceeding([p[todo] for p in products], threshold[todo])
        enough = np.bincount(rows, minlength=len(todo)) >= code.least
        done = enough[rows]
        found.append((todo[rows[done]], caps[done]))
        todo = todo[~enough]
        threshold[todo] -= 0.05
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _exceeding(products: list[np.ndarray], threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(threshold)
    best = np.stack([p.max(axis=1) for p in products])
    after = np.concatenate((np.cumsum(best[::-1], axis=0)[::-1][1:], np.zeros((1, n))))
    rows, caps, sums = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
    for segment, product in enumerate(products):
        sums = sums[:, None] + product[rows]
        which, word = np.nonzero(sums + after[segment][rows][:, None] >= threshold[rows][:, None])
        rows, caps, sums = rows[which], caps[which] * product.shape[1] + word, sums[which, word]
    return rows, caps


def unit_rows(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _decode(code: Code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                rows, caps = list_decode(code, unit_rows(rows_of(batch.column("vector"), np.float64)))
                order = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(order), batch.column("vector").take(order), batch.column("times").take(order), pa.array(caps)],
                    ["node", "vector", "times", "cap"],
                )

    return run


def _linked(units: np.ndarray, cosine: float) -> np.ndarray:
    linked = np.zeros((len(units), len(units)), bool)
    for a in range(0, len(units), 512):
        linked[a : a + 512] = units[a : a + 512] @ units.T >= cosine
    np.fill_diagonal(linked, False)
    return linked


def _verify(code: Code, cosine: float):
    """Per vector of a run of ``cap, i, j``: links that count here, and its edge to the run's component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cap, i, j), table in runs(batches, ["cap", "i", "j"]):
            units = unit_rows(rows_of(table.column("vector"), np.float64))
            side = table.column("x").to_numpy()
            linked = _linked(units, cosine)
            if i != j:  # pairs within a block are counted where it meets itself
                linked &= side[:, None] != side[None, :]
            has = np.flatnonzero(linked.any(axis=1))
            if not len(has):
                continue
            linked = linked[np.ix_(has, has)]
            times = table.column("times").to_numpy()[has]
            label = np.arange(len(has))
            while True:
                low = np.minimum(label, np.where(linked, label[None, :], len(has)).min(axis=1))
                if (low == label).all():
                    break
                label = low[low]
            rows, caps = list_decode(code, units[has])
            earlier = caps < cap
            rows, caps = rows[earlier], caps[earlier]
            order = np.argsort(rows, kind="stable")
            ends = np.searchsorted(rows[order], np.arange(len(has) + 1))
            sets = [caps[order[a:b]] for a, b in zip(ends[:-1], ends[1:])]
            counted = linked & (common_counts(sets) == 0)
            nodes = table.column("node").combine_chunks().take(pa.array(has))
            yield pa.RecordBatch.from_arrays(
                [nodes, pa.array(counted @ times), nodes.take(pa.array(label))], ["node", "links", "other"]
            )

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9,
    code: Code | None = None,
) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row of ``vectors``.

    Rows are linked where the cosine, in double precision, is at least ``cosine``. A pair is missed
    only if it shares no cap; at the threshold that is rarer than 1 in 1,000 on random vectors.

    * Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: no
      links, a component of their own, kept.
    * Equal vectors and repeated rows link with each other; ties go to the smallest id.
    * Vectors of different widths are never linked. Null ids keep their links, but name a component
      only if all its ids are null. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    usable = _sound(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    node = F.when(usable, F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.hash("vector"))))
    rows = rows.withColumn("node", node)
    nodes = stored(
        rows.filter("node is not null").groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("times")), "nodes"
    )
    sizes = {r["w"]: r["count"] for r in nodes.groupBy(F.size("vector").alias("w")).count().collect()}
    found = None
    for width, n in sorted(sizes.items()):
        one = _links_of_width(nodes.filter(F.size("vector") == width), code if code and code.width == width else make_code(width, n, cosine), cosine)
        found = one if found is None else found.union(one)
    if found is None:
        alone = F.lit(0).cast("long")
        return rows.select(F.col("id").alias(id_col), alone.alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))).select("node", "root")
    about = nodes.select("node", "times").join(links, "node", "left").join(roots, "node", "left")
    about = about.select("node", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    rows = rows.select("id", "node").join(about, "node", "left")
    lowest = rows.filter("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    alone = F.col("root").isNull()
    return rows.join(lowest, "root", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).alias("kept"),
    )


def _links_of_width(nodes: DataFrame, code: Code, cosine: float) -> DataFrame:
    kind = nodes.schema["vector"].dataType.simpleString()
    held = nodes.select("node", "vector", "times").mapInArrow(
        _decode(code), f"node string, vector {kind}, times long, cap long"
    )
    sizes = held.groupBy("cap").count().filter("count > 1")
    blocks = sizes.select("cap", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    held = held.join(small(stored(blocks, "caps"), 64), "cap")
    held = held.withColumn("x", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    held = held.withColumn("y", F.explode(F.expr("sequence(0, blocks - 1)")))
    held = held.select("cap", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "node", "vector", "times")
    held = held.repartition("cap", "i", "j").sortWithinPartitions("cap", "i", "j")
    return held.mapInArrow(_verify(code, cosine), "node string, links long, other string")
