"""Near-duplicate texts by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 2^32 shingle positions make every coordinate of a signature: ``_place``
places each shingle, ``_scramble`` ranks the places, and coordinate ``k`` is the smallest rank after
all places are shifted round the circle by ``k``. Coordinates are cut into bands; texts that agree in
a whole band are candidates, and a pair counts only after its full shingle sets have been compared.

Texts, not rows, are compared: rows with the same text are one node, whatever their number. Within a
band's bucket every text is compared with the bucket's leader first, which is linear in the bucket.
Buckets that still hold several components are then compared in blocks of bounded size: a task counts
the common shingles of all texts of two blocks as a matrix product over their full sets and hands on
only the links that join components. So a group of thousands of near copies never becomes rows of
pairs, and no link between components is lost.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, small, stored

#: 32 bands of 5: a pair at similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 32, 5
#: Shingles whose coordinates are computed at once; keeps the work arrays in the processor's cache.
_BLOCK = 1024
#: Shingles of a block of texts, and the least that a text counts for: blocks of 1,024 texts at most.
BLOCK_SHINGLES, LEAST_WEIGHT = 1 << 18, 256

_ODD = np.random.default_rng(20240501).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Distinct 64-bit fingerprints of the word shingles of ``text``, sorted.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer than ``width``
    words is one shingle; without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out += hashes[i : len(words) - n + 1 + i] * _ODD[i]
    return np.unique(out)


def _xorshift_multiply(x: np.ndarray, spare: np.ndarray, shifts: tuple, factors: tuple) -> None:
    """A bijection of the 32-bit numbers, in place: each step can be undone."""
    for shift, factor in zip(shifts, factors):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(15), out=spare)
    np.bitwise_xor(x, spare, out=x)


def _place(shingles: np.ndarray) -> np.ndarray:
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    _xorshift_multiply(x, np.empty_like(x), (17, 11), (0xED5AD4BB, 0xAC4C1B51))
    return x


def _scramble(x: np.ndarray, spare: np.ndarray) -> None:
    _xorshift_multiply(x, spare, (16, 15), (0x7FEB352D, 0x846CA68B))


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of a non-empty shingle set."""
    places = _place(shingles)
    shift = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(places), _BLOCK):
        x = places[None, start : start + _BLOCK] - shift
        _scramble(x, np.empty_like(x))
        np.minimum(best, x.min(axis=1), out=best)
    return best


def band_hashes(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    table = signature(shingles, bands * rows).reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _ODD[40]
    for i in range(rows):
        out += table[:, i] * _ODD[20 + i]
        out ^= out >> np.uint64(29)
        out *= _ODD[30 + i]
    return out.view(np.int64)


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sizes, buckets = [], []
                for text in batch.column("text"):
                    shingles = shingle_hashes(text.as_py(), width)
                    sizes.append(len(shingles))
                    buckets.append(band_hashes(shingles, bands, rows) if len(shingles) else None)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("id", "key")), pa.array(sizes, pa.int64()),
                     pa.array(buckets, pa.list_(pa.int64()))],
                    ["id", "key", "n_shingles", "buckets"],
                )

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def shingles(key: bytes, text) -> np.ndarray:
            if key not in kept:
                kept[key] = shingle_hashes(text.as_py(), width)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[key]

        for batch in batches:
            linked = []
            for a, b, s, t in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b"))):
                x, y = shingles(a.as_py(), s), shingles(b.as_py(), t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose full shingle sets are similar enough."""
    named = lambda side: texts.select(F.col("key").alias(side), F.col("text").alias(f"text_{side}"))
    joined = pairs.join(named("b"), "b").join(named("a"), "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_confirm(width, percent), "a binary, b binary")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sets = [shingle_hashes(t.as_py(), width).view(np.int64) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"]
                )

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    held = shared[column]
    owner, column = owner[held], place[column[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        dense = np.zeros((len(sets), 4096), np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        out += dense @ dense.T
    return out


def _joining_links(keys: list, roots: list, sets: list, percent: int) -> list[tuple]:
    """Links between the components of a block, as few as join all of them that are linked."""
    sizes = np.array([len(s) for s in sets])
    _, root = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)
    if len(sets) < 2 or root.max() == 0:
        return []
    both = common_counts(sets)
    linked = 100 * both.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - both.astype(np.int64))
    linked &= root[:, None] < root[None, :]
    found, parent = [], list(range(int(root.max()) + 1))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in zip(*np.nonzero(linked)):
        x, y = top(root[i]), top(root[j])
        if x != y:
            parent[y] = x
            found.append((keys[i], keys[j]))
    return found


def _compare_blocks(percent: int):
    """Links of runs of rows with equal ``bucket, i, j``; rows come sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        roots: list = []
        sets: list = []
        now = None

        def links() -> pa.RecordBatch:
            found = _joining_links(keys, roots, sets, percent)
            for held in (keys, roots, sets):
                held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"]
            )

        for batch in batches:
            names = ("bucket", "i", "j", "key", "root", "shingles")
            for bucket, i, j, key, root, shingles in zip(*(batch.column(c) for c in names)):
                group = (bucket.as_py(), i.as_py(), j.as_py())
                if group != now:
                    if keys:
                        yield links()
                    now = group
                keys.append(key.as_py())
                roots.append(root.as_py())
                sets.append(np.array(shingles.values))
        if keys:
            yield links()

    return run


def _links_across(member: DataFrame, texts: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between texts that share a bucket and are in different components so far."""
    grouped = member.join(groups.select(F.col("node").alias("key"), "root"), "key", "left").select(
        "bucket", "key", F.greatest("n", F.lit(LEAST_WEIGHT)).alias("n"), F.coalesce("root", "key").alias("root")
    )
    mixed = grouped.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("n"))
    mixed = mixed.filter("low != high").select("bucket", F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    grouped = stored(grouped.drop("n").join(mixed, "bucket"), "mixed")
    needed = small(stored(grouped.select("key").distinct(), "keys"), 64)
    sets = texts.join(needed, "key", "left_semi").mapInArrow(_sets(width), "key binary, shingles array<long>")
    # A text of block x takes part in the comparisons of x with every block: (x, y) or (y, x).
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = grouped.withColumn("x", block).withColumn("y", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("bucket", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "key", "root")
    dealt = dealt.join(sets, "key").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(_compare_blocks(percent), "a binary, b binary")


def _rooted(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``id, key, n_shingles, root`` for every row: hash of the text, and the component's smallest one.

    ``root`` is null where there are no shingles.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("key", F.unhex(F.md5("text")))
    signed = stored(
        docs.mapInArrow(
            _sign(width, bands, rows), "id long, key binary, n_shingles long, buckets array<long>"
        ),
        "signatures",
    )
    nodes = signed.filter("n_shingles > 0").groupBy("key").agg(
        F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets")
    )
    member = nodes.select("key", "n", F.explode("buckets").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.min(F.struct("key", "n")).alias("leader"), F.count("*").alias("size"))
    member = stored(member.join(shared.filter("size > 1").drop("size"), "bucket"), "buckets")

    def similar_sizes(m: str, n: str):
        return 100 * F.least(m, n) >= percent * F.greatest(m, n)

    first = (
        member.filter(F.col("key") != F.col("leader.key")).filter(similar_sizes("n", "leader.n"))
        .select(F.col("leader.key").alias("a"), F.col("key").alias("b")).distinct()
    )
    texts = docs.filter("text is not null").join(
        small(stored(member.select("key").distinct(), "keys"), 64), "key", "left_semi"
    )
    texts = stored(texts.groupBy("key").agg(F.first("text").alias("text")), "texts")
    edges = stored(_links(first, texts, width, percent), "links")

    more = stored(_links_across(member, texts, components(edges), width, percent), "links")
    groups = components(edges.union(more)).select(F.col("node").alias("key"), "root")

    rows_ = signed.select("id", "n_shingles", "key").join(groups, "key", "left")
    root = F.when(F.col("n_shingles") > 0, F.coalesce("root", "key"))
    return rows_.select("id", "key", "n_shingles", root.alias("root"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Rows are linked where ``100 * |A & B| >= percent * |A | B|`` of their word-shingle sets.
    ``component_id`` is the smallest id that links lead to; ``kept`` marks the row that has it.

    * Null or empty text, or only white space: no shingles, linked with nothing, kept.
    * Repeated rows and rows with equal texts are linked; ties go to the smallest id.
    * Null id: keeps its links, but is never a component's id unless all its ids are null.
    * Other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    rows_ = _rooted(docs, id_col, text_col, width, percent, bands, rows)
    lowest = rows_.filter("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    return rows_.join(lowest, "root", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("root").isNull() | F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row of ``docs`` for each component of ``near_duplicates``. Columns as they are.

    The row with the smallest id stays, null ids last; of several texts with that id the one with the
    smallest hash. Rows without shingles all stay. Rows with equal id and text are one document.
    """
    rows_ = _rooted(docs, id_col, text_col, width, percent, bands, rows)
    per = rows_.groupBy("root", "id", "key").agg(F.count("*").alias("n"))
    # Rows without shingles are components of their own.
    lone = F.when(F.col("root").isNull(), F.struct("id", "key")).alias("lone")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key", "n")).alias("row")
    chosen = per.groupBy("root", lone).agg(first).select(
        F.col("row.id").alias("_id"), F.col("row.key").alias("_key"), F.col("row.n").alias("_n")
    )
    chosen = stored(chosen, "kept")
    same = docs[id_col].cast("long").eqNullSafe(F.col("_id")) & F.unhex(F.md5(docs[text_col])).eqNullSafe(F.col("_key"))
    stay = docs.join(small(chosen, 64), same, "left_semi")
    return stay.dropDuplicates([id_col, text_col]) if chosen.filter("_n > 1").limit(1).count() else stay
