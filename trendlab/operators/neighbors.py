"""Vectors of terms and the exact k-nearest-neighbour self-join.

An exact cosine join of dense vectors has to look at every pair; what Spark decides is how. Terms
are dealt into blocks of bounded size, and a block is one row from there on. A task holds some blocks
and meets, one after another, those that can hold a neighbour of theirs. It keeps the best ``k`` of each
of its rows, so neither pairs nor lists per pair of blocks are shuffled.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from trendlab.functions import l2_normalize, ngram_embedder
from trendlab.functions.embedding import Embedder
from trendlab.operators.tiles import PACKED, nearest, own_bars, pack

# Executors need not have this package installed: the assignment pass travels with the task.
from pyspark import cloudpickle  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a block: at 384 dimensions a tile holds two blocks of 50 MB each in DOUBLE.
MAX_BLOCK_ROWS = 16_384
MIN_BLOCK_ROWS = 256
TILES_PER_TASK = 4
# Rows whose neighbours one task looks for: at 384 dimensions 150 MB. Each task reads all vectors that can
# be their neighbours, so fewer tasks shuffle less; there are a few per core, to be dealt evenly.
QUERY_ROWS = 32_768
TASKS_PER_CORE = 3


def parallelism(df: DataFrame) -> int:
    """Number of tasks for work that is heavy per row but small in bytes."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def embed_terms(terms: DataFrame, embedder: Embedder | None = None, spread: bool = False) -> DataFrame:
    """Unit vectors of distinct terms, stored as FLOAT. Other columns pass through.

    ``spread`` first deals the rows out to all tasks. A vocabulary is small in bytes, so that Spark
    would otherwise read or coalesce it into few tasks, while embedding is slow per row.
    """
    embed = embedder or ngram_embedder()
    rows = terms.repartition(parallelism(terms)) if spread else terms
    raw = rows.withColumn("vector", embed(F.col("term")))
    return raw.withColumn("vector", l2_normalize(F.col("vector")).cast("array<float>"))


def _block_count(vectors: DataFrame, tasks: int, block_rows: int | None) -> Column:
    """Number of blocks as a scalar subquery: enough tiles to use the cluster, none too large."""
    n = F.count(F.lit(1))
    if block_rows:
        blocks = F.ceil(n / F.lit(block_rows))
    else:
        enough = F.least(F.ceil(n / F.lit(MIN_BLOCK_ROWS)), F.lit(math.ceil(math.sqrt(2 * TILES_PER_TASK * tasks))))
        blocks = F.greatest(F.ceil(n / F.lit(MAX_BLOCK_ROWS)), enough)
    return vectors.agg(F.greatest(blocks, F.lit(1)).cast("int").alias("blocks")).scalar()


def tasks_for(vectors: DataFrame) -> int:
    """Tasks for ``knn_join`` over stored vectors: a few tiles each, however many tiles there are."""
    blocks = math.ceil(vectors.count() / MAX_BLOCK_ROWS)
    return max(parallelism(vectors), math.ceil(blocks * (blocks + 1) / 2 / TILES_PER_TASK))


#: Centres fitted on at most this many vectors per block (a bounded sample, chosen by hash of term).
CENTRE_SAMPLE = 4
#: Slack of the bound on a product: float vectors, rounding to 9 digits.
BOUND_SLACK = 1e-6


def materialized(df: DataFrame) -> DataFrame:
    """``df`` checkpointed into the shared folder named by the session (set here in local mode only)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trendlab-checkpoints-"))
    return df.checkpoint(eager=True)


def _assign(centres: np.ndarray):
    """Nearest centre, angle to it and norm of each vector; unsound vectors get cluster -1."""
    import pyarrow as pa

    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    width = unit.shape[1]

    def run(batches):
        for b in batches:
            vectors = b.column("vector")
            cluster = np.full(b.num_rows, -1, dtype=np.int64)
            angle, norm = np.full(b.num_rows, np.pi), np.zeros(b.num_rows)
            lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            good = np.flatnonzero(lengths == width)
            if len(good):
                chosen = vectors.take(pa.array(good))
                x = chosen.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                n = np.linalg.norm(x, axis=1)
                ok = np.isfinite(n) & (n > 0)
                dots = (x[ok] / n[ok, None]) @ unit.T
                best = np.argmax(dots, axis=1)
                idx = good[ok]
                cluster[idx] = best
                angle[idx] = np.arccos(np.clip(dots[np.arange(len(best)), best], -1.0, 1.0))
                norm[idx] = n[ok]
            yield pa.RecordBatch.from_arrays(
                [b.column("term"), vectors, b.column("place"), pa.array(cluster), pa.array(angle), pa.array(norm)],
                names=["term", "vector", "place", "cluster", "angle", "norm"])
    return run


def _bounds(blocks: list, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest product any pair of two blocks can have, per pair of blocks (unsound blocks: +inf)."""
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    cl = np.array([b.cluster for b in blocks])
    radius = np.array([b.radius for b in blocks])
    high, low = np.array([b.high for b in blocks]), np.array([b.low for b in blocks])
    between = np.arccos(np.clip(unit[np.maximum(cl, 0)] @ unit[np.maximum(cl, 0)].T, -1.0, 1.0))
    closest = np.maximum(0.0, between - radius[:, None] - radius[None, :])
    cos = np.cos(closest)
    bound = np.where(cos >= 0, cos * np.outer(high, high), cos * np.outer(low, low))
    bound = bound + BOUND_SLACK * np.outer(high, high)
    bad = cl < 0
    bound[bad, :] = np.inf
    bound[:, bad] = np.inf
    return bound, np.array([b.block for b in blocks])


def knn_join(
    vectors: DataFrame, k: int = 20, threshold: float | None = None, block_rows: int | None = None,
    tasks: int | None = None, report: dict | None = None,
) -> DataFrame:
    """The ``k`` most similar terms of each term, itself included: ``term, neighbor, sim, pos``.

    Neighbours are ordered by similarity (the product of the vectors), then term. ``threshold``
    drops neighbours below it. Exact: terms are grouped around centres (the vectors of smallest
    term hash, ``CENTRE_SAMPLE`` per block wanted, best of them by an assignment pass) into blocks of
    at most ``block_rows`` (larger clusters are split by hash); each block knows its angular radius
    and the range of its norms. A block is compared with another only if the bound on their products,
    from angle(c1, c2) - r1 - r2 and the norms, reaches its bar: the threshold, and without one the
    k-th best product that each of its terms already has inside it (sought only where it can rule out
    a block). Terms without a sound vector (null, other length, zero, not finite) are never pruned;
    null vectors find nothing. Until the end a number in term order stands for a term. ``report``
    receives the pairs of blocks, in both directions, that were compared and that there are.
    """
    tasks = tasks or parallelism(vectors)
    vectors = materialized(vectors.select("term", "vector").where(F.col("vector").isNotNull()))
    n = vectors.count()
    most = block_rows or MAX_BLOCK_ROWS
    wanted = max(1, math.ceil(n / most), min(math.ceil(n / MIN_BLOCK_ROWS), math.ceil(math.sqrt(2 * TILES_PER_TASK * tasks))))
    target = block_rows or min(MAX_BLOCK_ROWS, max(MIN_BLOCK_ROWS, math.ceil(n / wanted)))
    sample = vectors.orderBy(F.xxhash64("term"), "term").limit(wanted * CENTRE_SAMPLE).collect()
    widths = [len(r.vector) for r in sample]
    width = max(set(widths), key=widths.count) if widths else 0
    kept = [r.vector for r in sample if len(r.vector) == width]
    pool = np.array(kept, dtype=np.float64).reshape(len(kept), width) if width else np.zeros((0, 1))
    pool = pool[np.isfinite(pool).all(axis=1) & (np.linalg.norm(pool, axis=1) > 0)] if len(pool) else pool
    if len(pool) == 0:  # nothing sound to centre on: one centre, every pair is computed
        pool = np.ones((1, max(width, 1)))
    # Farthest-point choice among the sample: centres spread over the sphere.
    unit = pool / np.linalg.norm(pool, axis=1, keepdims=True)
    chosen = [0]
    far = 1 - unit @ unit[0]
    while len(chosen) < min(wanted, len(unit)):
        nxt = int(np.argmax(far))
        if far[nxt] <= 0:
            break
        chosen.append(nxt)
        far = np.minimum(far, 1 - unit @ unit[nxt])
    centres = pool[chosen]
    schema = T.StructType([vectors.schema["term"], vectors.schema["vector"], T.StructField("place", T.LongType()),
                           T.StructField("cluster", T.LongType()), T.StructField("angle", T.DoubleType()),
                           T.StructField("norm", T.DoubleType())])
    placed = vectors.orderBy("term").withColumn("place", F.monotonically_increasing_id())
    assigned = materialized(placed.mapInArrow(_assign(centres), schema))
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("size"))
    split = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(target)))
    packed = materialized(
        assigned.join(F.broadcast(sizes), "cluster").withColumn(
            "block", (F.col("cluster") * F.lit(1 << 20) + F.pmod(F.xxhash64("place"), split)).cast("long"))
        .select("block", *assigned.columns).groupBy("block").applyInArrow(pack(k), PACKED))
    blocks = packed.select("block", "cluster", "radius", "high", "low", "size").collect()
    spark = vectors.sparkSession
    if not blocks:
        if report is not None:
            report.update(tiles=0, possible=0, blocks=0)
        return spark.createDataFrame([], "term string, neighbor string, sim double, pos int")
    bound, ids = _bounds(blocks, centres)
    floor = np.full(len(blocks), -np.inf if threshold is None else float(threshold))
    if threshold is None:
        # No bar is above the largest product of the block's shortest vector: it could not rule out any block.
        largest = np.array([b.low * b.high for b in blocks])
        useful = [int(x) for x in ids[bound.min(axis=1) < largest]]
        own = packed.where(F.col("block").isin(useful)).mapInArrow(own_bars(k), "block long, bar double")
        bars = {r.block: r.bar for r in own.collect()} if useful else {}
        floor = np.array([bars.get(b.block, -np.inf) for b in blocks])
    needed = bound >= floor[:, None]
    np.fill_diagonal(needed, True)
    if report is not None:
        report.update(tiles=int(needed.sum()), possible=needed.size, blocks=len(blocks))
    shares = _shares(np.array([b.size for b in blocks]), needed, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    dealt = []
    for task, share in enumerate(shares):
        dealt += [(task, 0, int(ids[q]), float(floor[q]), None) for q in share]
        dealt += [(task, 1 if t in share else 2, int(ids[t]), None, [int(x) for x in ids[share][needed[share, t]]])
                  for t in np.flatnonzero(needed[share].any(axis=0))]
    pairs = spark.createDataFrame(dealt, "task int, seq int, block long, floor double, queries array<long>")
    pairs = F.broadcast(pairs) if (len(dealt) * 5 + int(needed.sum())) * 8 <= 32 << 20 else pairs
    found = (packed.join(pairs, "block")
             .withColumn("terms", F.when(F.col("seq") == 0, F.col("terms")))
             .repartitionById(len(shares), "task").sortWithinPartitions("task", "seq")
             .mapInArrow(nearest(k), "term string, neighbor long, sim double"))
    names = assigned.select(F.col("place").alias("neighbor"), F.col("term").alias("name"))
    found = found.join(names, "neighbor").select("term", F.col("name").alias("neighbor"), "sim")
    by_similarity = Window.partitionBy("term").orderBy(F.desc("sim"), F.asc("neighbor"))
    return found.withColumn("pos", F.row_number().over(by_similarity)).where(F.col("pos") <= k)


def _shares(sizes: np.ndarray, needed: np.ndarray, tasks: int) -> list[np.ndarray]:
    """Blocks dealt to tasks, so that these compare about equally many pairs of rows; the longest task first."""
    tasks = min(len(sizes), max(tasks, math.ceil(sizes.sum() / QUERY_ROWS)))
    work = sizes * (needed @ sizes)
    share, load, rows = [[] for _ in range(tasks)], np.zeros(tasks), np.zeros(tasks)
    for block in np.argsort(-work, kind="stable"):
        full = rows + sizes[block] > max(QUERY_ROWS, 2 * sizes[block])
        task = int(np.argmin(np.where(full, load + work.sum(), load)))
        share[task].append(block)
        load[task] += work[block]
        rows[task] += sizes[block]
    return [np.array(share[t]) for t in np.argsort(-load, kind="stable") if share[t]]
