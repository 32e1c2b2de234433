"""What one task does for the neighbour join: matrix products and the best ``k`` so far of each row."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Similarities are compared after rounding, so ties do not depend on summation order.
SIM_DIGITS = 9
# Rows and columns of one product, 2 MB of scores: they stay in a core's cache until they are compared.
STRIP_ROWS, STRIP_COLUMNS = 512, 1_024
# Scores of one row of which only the largest is compared at first.
SEGMENT = 256
# Above this share of scores over the floor, rows are cut to their k best before sorting.
DENSE = 0.05
# Vectors up to this norm are compared in single precision first.
SINGLE_NORM = 1e15
# Pairs whose product is taken in double precision at once.
PAIRS = 4_096
# Place of nobody, after all others.
NOBODY = np.iinfo(np.int64).max

PACKED = (
    "block long, cluster long, radius double, high double, low double, size long, width int, single boolean, "
    "terms array<string>, places binary, vectors binary, first binary"
)


def _matrix_of(table: pa.Table) -> np.ndarray:
    vectors = table.column("vector").combine_chunks()
    widths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(widths) != 1:
        raise ValueError(f"vectors of one table must have one width, not {sorted(widths)}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    kind = np.float32 if flat.dtype == np.float32 else np.float64
    return flat.astype(kind, copy=False).reshape(len(vectors), widths[0])


def _rounded(scores: np.ndarray) -> np.ndarray:
    scale = 10.0**SIM_DIGITS
    return np.floor(scores * scale + 0.5) / scale


def _strip_top_k(scores: np.ndarray, k: int, floor: float | np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, column and rounded score of the ``k`` best columns per row that reach ``floor`` (one, or one per row).

    Columns stand in term order, so equal rounded scores are settled by column. Only candidates are
    rounded: one rounding unit of slack keeps whatever could still round up to the bar.
    """
    scale = 10.0**SIM_DIGITS
    floor = np.broadcast_to(np.asarray(floor, dtype=np.float64), scores.shape[:1])
    bar = floor - 1 / scale
    over = scores >= bar[:, None]
    if scores.shape[1] > k and np.count_nonzero(over) > DENSE * scores.size:
        known = np.where(np.isnan(scores), -np.inf, scores)
        kth = np.partition(known, scores.shape[1] - k, axis=1)[:, -k]
        over = scores >= np.maximum(bar, kth - 1 / scale)[:, None]
    row, col = np.nonzero(over)
    sim = _rounded(scores[row, col])
    reached = sim >= floor[row]
    row, col, sim = row[reached], col[reached], sim[reached]
    return _first_k(row, col, sim, k)


def _first_k(row: np.ndarray, col: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of each row; ties go to the smaller column."""
    order = np.lexsort((col, -sim, row))
    row, col, sim = row[order], col[order], sim[order]
    first_k = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[first_k], col[first_k], sim[first_k]


def _first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the first ``k`` of those equal to them: no other can be a neighbour, for ties go by place."""
    if not x.size:
        return np.ones(len(x), dtype=bool)
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    group = np.unique(whole, return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    ranked = group[order]
    first = np.empty(len(x), dtype=bool)
    first[order] = np.arange(len(x)) - np.searchsorted(ranked, ranked, side="left") < k
    return first


def pack(k: int) -> Callable[[pa.Table], pa.Table]:
    """All rows of a block as one row of ``PACKED``, in the order of their places."""

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending")])
        x = _matrix_of(table)
        return pa.table({
            "block": table.column("block")[:1].combine_chunks(), "cluster": table.column("cluster")[:1].combine_chunks(),
            "radius": [pc.max(table.column("angle")).as_py()], "high": [pc.max(table.column("norm")).as_py()],
            "low": [pc.min(table.column("norm")).as_py()], "size": pa.array([len(x)], pa.int64()),
            "width": pa.array([x.shape[1]], pa.int32()), "single": [x.dtype == np.float32],
            "terms": pa.array([table.column("term").to_pylist()], pa.list_(pa.string())),
            "places": [table.column("place").to_numpy().tobytes()], "vectors": [x.tobytes()],
            "first": [_first_copies(x, k).tobytes()],
        })

    return packed


class _Rows:
    """Places and vectors of some rows, the vectors also in single precision where that is safe.
    The latter end with zeros, up to whole segments."""

    def __init__(self, places: np.ndarray, x: np.ndarray):
        self.places, self.x = places, x
        self.norms = np.linalg.norm(x.astype(np.float64, copy=False), axis=1)
        self.high = self.norms.max(initial=0.0)
        self.sound = bool(self.high <= SINGLE_NORM)  # false for NaN
        self.single = np.zeros((-(-len(x) // SEGMENT) * SEGMENT, x.shape[1]), np.float32) if self.sound else None
        if self.sound:
            self.single[:len(x)] = x

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int, first: bool) -> _Rows:
        """Those of a packed block; with ``first`` only those that can be neighbours."""
        held = {c: batch.column(c)[i] for c in ("places", "vectors", "first", "width", "single", "size")}
        places = np.frombuffer(held["places"].as_buffer(), dtype=np.int64)
        x = np.frombuffer(held["vectors"].as_buffer(), dtype=np.float32 if held["single"].as_py() else np.float64)
        x = x.reshape(held["size"].as_py(), held["width"].as_py())
        if first:
            kept = np.frombuffer(held["first"].as_buffer(), dtype=bool)
            if not kept.all():
                return cls(places[kept], x[kept])
        return cls(places, x)


class _Strip:
    """The best ``k`` so far of a few rows: their rounded similarities and places, best first.

    Scores are taken in single precision and compared with each row's bar less the largest error they can
    have; what passes is taken again in double precision. So the result is that of double precision.
    What passes waits until it is half of what the rows hold, so rows are sorted a few times in all.
    """

    def __init__(self, rows: _Rows, start: int, k: int, floor: float):
        part = slice(start, start + STRIP_ROWS)
        self.x, self.norms, self.sound, self.k = rows.x[part], rows.norms[part], rows.sound, k
        self.single = rows.single[part][:len(self.x)] if rows.sound else None
        self.sim = np.full((len(self.x), k), -np.inf)
        self.place = np.full((len(self.x), k), NOBODY)
        self.floor = np.full(len(self.x), floor)
        self.waiting, self.n_waiting = [], 0

    def see(self, targets: _Rows, scratch: np.ndarray) -> None:
        if targets.x.shape[1] != self.x.shape[1]:
            raise ValueError(f"vectors must have one width, not {self.x.shape[1]} and {targets.x.shape[1]}")
        for start in range(0, len(targets.x), STRIP_COLUMNS):
            part = slice(start, start + STRIP_COLUMNS)
            row, col, sim = self._passing(targets, part, scratch)
            if len(row):
                self.waiting.append((row, targets.places[part][col], sim))
                self.n_waiting += len(row)
                if 2 * self.n_waiting >= self.sim.size:
                    self.settle()

    def _passing(self, targets: _Rows, part: slice, scratch: np.ndarray) -> tuple[np.ndarray, ...]:
        y = targets.x[part]
        if not (self.sound and targets.sound):
            return _strip_top_k(self.x.astype(np.float64) @ y.astype(np.float64).T, self.k, self.floor)
        other = targets.single[part].T
        scores = scratch[:len(self.x) * other.shape[1]].reshape(len(self.x), -1)
        np.matmul(self.single, other, out=scores)
        # Each of the products and sums, and each vector's rounding, adds at most 2^-24 of the norms' product.
        error = (self.x.shape[1] + 8) * 2.0**-24 * targets.high * self.norms + 1e-25
        bar = np.nextafter((self.floor - 10.0**-SIM_DIGITS - error).astype(np.float32), np.float32(-np.inf))
        segments = scores.reshape(len(self.x), -1, SEGMENT)
        owner, segment = np.nonzero(segments.max(axis=2) >= bar[:, None])
        some, col = np.divmod(np.flatnonzero(segments[owner, segment] >= bar[owner, None]), SEGMENT)
        row, col = owner[some], segment[some] * SEGMENT + col
        rows = np.unique(row)
        if len(row) > DENSE * len(rows) * len(y):
            row, col, sim = _strip_top_k(
                self.x[rows].astype(np.float64) @ y.astype(np.float64).T, self.k, self.floor[rows])
            return rows[row], col, sim
        row, col = row[col < len(y)], col[col < len(y)]
        sim = np.empty(len(row))
        for i in range(0, len(row), PAIRS):
            some = slice(i, i + PAIRS)
            sim[some] = np.einsum("ij,ij->i", self.x[row[some]].astype(np.float64), y[col[some]].astype(np.float64))
        sim = _rounded(sim)
        reached = sim >= self.floor[row]
        return row[reached], col[reached], sim[reached]

    def settle(self) -> None:
        """Sorts what waits into what is held and raises the bars."""
        if not self.waiting:
            return
        row, place, sim = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.n_waiting = [], 0
        met = np.unique(row)
        _, place, sim = _first_k(
            np.concatenate([np.repeat(met, self.k), row]), np.concatenate([self.place[met].ravel(), place]),
            np.concatenate([self.sim[met].ravel(), sim]), self.k)
        self.place[met], self.sim[met] = place.reshape(-1, self.k), sim.reshape(-1, self.k)
        self.floor = np.maximum(self.floor, self.sim[:, -1])


class _Query:
    """A block whose neighbours are looked for."""

    def __init__(self, rows: _Rows, k: int, floor: float, terms: pa.Array | None = None):
        self.terms = terms
        self.strips = [_Strip(rows, start, k, floor) for start in range(0, len(rows.x), STRIP_ROWS)]

    def see(self, targets: _Rows) -> None:
        scratch = np.empty(STRIP_ROWS * STRIP_COLUMNS, np.float32)
        for strip in self.strips:
            strip.see(targets, scratch)

    def found(self) -> Iterator[pa.RecordBatch]:
        start = 0
        for strip in self.strips:
            strip.settle()
            row, col = np.nonzero(strip.place != NOBODY)
            yield pa.RecordBatch.from_arrays(
                [self.terms.take(pa.array(row + start)), pa.array(strip.place[row, col]), pa.array(strip.sim[row, col])],
                names=["term", "neighbor", "sim"])
            start += len(strip.x)


def own_bars(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each packed block the smallest k-th best similarity that its rows have inside it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bars = []
            for i in range(batch.num_rows):
                query = _Query(_Rows.of(batch, i, False), k, -np.inf)
                query.see(_Rows.of(batch, i, True))
                for strip in query.strips:
                    strip.settle()
                bars.append(min(float(strip.sim[:, -1].min()) for strip in query.strips))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(bars, pa.float64())], names=["block", "bar"])

    return run


def nearest(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` best of each row of a task's blocks: first come these blocks (``seq`` 0, with the lowest
    similarity that counts), then the blocks they are compared with, each with the ``queries`` that need it.
    One of the latter is held at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, queries = None, {}
        for batch in batches:
            tasks, seqs = batch.column("task").to_pylist(), batch.column("seq").to_pylist()
            for i, (t, seq) in enumerate(zip(tasks, seqs)):
                if t != task:
                    for query in queries.values():
                        yield from query.found()
                    task, queries = t, {}
                if seq == 0:
                    terms = batch.column("terms")[i].values
                    rows = _Rows.of(batch, i, False)
                    queries[batch.column("block")[i].as_py()] = _Query(rows, k, batch.column("floor")[i].as_py(), terms)
                else:
                    targets = _Rows.of(batch, i, True)
                    for block in batch.column("queries")[i].as_py():
                        queries[block].see(targets)
        for query in queries.values():
            yield from query.found()

    return run
