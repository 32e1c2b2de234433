"""Packing documents into fixed windows of token ids, by bounded-space online packing.

Every task keeps at most ``open_windows`` open windows of ``capacity`` ids. Its documents arrive one
by one; a document's ids (the tokenizer's, then the end id) are placed as a piece into the open
window that fits it most tightly (best fit). Where none fits and no window may be opened, the
fullest window is topped up with the head of the piece (pieces may be cut freely), emitted full, and
the rest placed again. A piece longer than a window is cut into whole windows first. What stays open
at the end of a task is merged: leftover windows of ``merge_fan_in`` tasks at a time are shuffled
together and packed the same way, level by level, until one group is left, whose last windows are
emitted as they are. So all sequences are full except the last one of the final group, and no task
ever holds more than ``open_windows`` windows, or ``merge_fan_in`` times that in a merge.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .token_counts import load_tokenizer
from .words import SPACE, CutIds, after_word

#: Fixed values of the contract: window size and the id that ends every document.
CAPACITY, END_ID = 2048, 1
#: Open windows per task; leftover groups merged at once.
OPEN_WINDOWS, MERGE_FAN_IN = 8, 32

#: Pieces whose ids each of a worker's two generations remembers; bounds its memory, not the result.
REMEMBERED = 600_000
#: Bytes that begin a character which is not white space in any script, and those of them before one or two more bytes.
_LEAD2 = np.isin(np.arange(256), range(0xC3, 0xE0))
_LEAD3 = np.isin(np.arange(256), [0xE0, *range(0xE4, 0xF0)])
_TEXT = ~SPACE & (np.arange(256) < 0x80) | _LEAD2 | _LEAD3 | (np.arange(256) >= 0xF0)

_WORKER: dict[str, PieceIds] = {}

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
         "offset long, leftover boolean, part long, ids array<int>")


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


class Packer:
    """Open windows of one task; ``emitted`` gathers closed windows as lists of pieces.

    A piece is ``(doc_id, start, ids, doc_tokens)``; a window is a list of pieces and its fill.
    """

    def __init__(self, capacity: int, open_windows: int, first_id: int):
        self.capacity, self.most, self.next_id = capacity, open_windows, first_id
        self.open: list[list] = []  # [fill, pieces]
        self.emitted: list[tuple[int, list]] = []

    def _emit(self, window):
        self.open.remove(window)
        self.emitted.append((self.next_id, window[1]))
        self.next_id += 1

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int):
        cap = self.capacity
        while len(ids) >= cap:  # whole windows of a long piece
            self.emitted.append((self.next_id, [(doc_id, start, ids[:cap], doc_tokens)]))
            self.next_id += 1
            start, ids = start + cap, ids[cap:]
        while len(ids):
            fits = [w for w in self.open if cap - w[0] >= len(ids)]
            if fits:
                w = min(fits, key=lambda w: cap - w[0])
            elif len(self.open) < self.most:
                w = [0, []]
                self.open.append(w)
            else:  # none fits: top up the fullest, emit it, place the rest again
                w = max(self.open, key=lambda w: w[0])
                room = cap - w[0]
                w[1].append((doc_id, start, ids[:room], doc_tokens))
                w[0] = cap
                self._emit(w)
                start, ids = start + room, ids[room:]
                continue
            w[1].append((doc_id, start, ids, doc_tokens))
            w[0] += len(ids)
            if w[0] == cap:
                self._emit(w)
            return


def _rows(windows, leftover: bool, part: int) -> dict:
    cols = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                            "leftover", "part", "ids")}
    for seq, pieces in windows:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            for k, v in (("doc_id", doc_id), ("start", start), ("length", len(ids)), ("ids_crc32", crc(ids)),
                         ("doc_tokens", doc_tokens), ("sequence_id", None if leftover else seq),
                         ("offset", None if leftover else offset), ("leftover", leftover), ("part", part),
                         ("ids", ids.tolist() if leftover else None)):
                cols[k].append(v)
            offset += len(ids)
    return cols


def _batch(cols: dict) -> pa.RecordBatch:
    types = {"ids": pa.list_(pa.int32()), "leftover": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in cols.items()],
                                      names=list(cols))


class PieceIds(CutIds):
    """Ids of texts through those of their pieces, remembered.

    A piece begins at a space or line end between two characters that are not white space, behind such a
    line end, and at a stop after a letter or number: the byte-level pre-tokenizer always starts a new
    pre-token there, and no special string holds such a place. Pieces go to the library in a row, with a
    line end, which has an id of its own, between them.
    """

    def __init__(self, tokenizer, remembered: int = REMEMBERED):
        super().__init__(tokenizer, remembered)
        self.line = tokenizer.token_to_id("Ċ")

    def cut(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Only such neighbours count as text whose bytes cannot be those of white space beyond ASCII.
        begins = _TEXT[data]
        ends = (data < 0x80) & begins
        ends[1:] |= _LEAD2[data[:-1]]
        ends[2:] |= _LEAD3[data[:-2]]
        ends[3:] |= data[:-3] >= 0xF0
        begins[rows[:-1][rows[:-1] < len(data)]] = False  # a row's end is no neighbour
        between = np.zeros(len(data), bool)
        between[1:-1] = ends[:-2] & begins[2:]
        marks = after_word(data)
        lines = between & (data == ord("\n"))
        marks |= lines | (between & (data == ord(" ")))
        marks[1:] |= lines[:-1]
        return data, marks

    def _is_line(self, piece: str) -> bool:
        """Text without line ends, at most one space before it and no white space behind."""
        text = piece[1:] if piece[0] == " " else piece
        if text.isalpha():
            return True
        return bool(text) and not (text[0].isspace() or text[-1].isspace() or "\n" in text or "<|" in text)

    def encoded(self, pieces: list[str]) -> list[bytes]:
        line = [p for p in pieces if self._is_line(p)] if self.line is not None else []
        known = dict(zip(line, self.joined(line, "\n", lambda ids: self.between(ids, self.line))))
        rest = [p for p in pieces if p not in known]
        known.update(zip(rest, self.whole(rest)))
        return [known[p] for p in pieces]


def _pack_documents(path: str, capacity: int, open_windows: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer = Packer(capacity, open_windows, part << 32)
        if path not in _WORKER:
            _WORKER[path] = PieceIds(load_tokenizer(path))
        end = np.uint32(end_id)
        for b, encoded in (part for whole in batches for part in _WORKER[path].batches(whole)):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoded):
                ids = np.append(ids, end)
                packer.add(doc_id, 0, ids, len(ids))
            if packer.emitted:
                yield _batch(_rows(packer.emitted, False, part))
                packer.emitted = []
        yield _batch(_rows([(None, w[1]) for w in packer.open], True, part))
    return run


def _merge(capacity: int, open_windows: int, level: int, final: bool):
    """Packs the leftover pieces of each group (rows sorted by group); ``part`` becomes the group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, now = None, None

        def close():
            if final:  # one window at a time for what is left: all full but the last
                rest = Packer(capacity, 1, packer.next_id)
                for w in sorted(packer.open, key=lambda w: -w[0]):
                    for piece in w[1]:
                        rest.add(*piece)
                packer.emitted += rest.emitted + [(rest.next_id, w[1]) for w in rest.open]
                packer.open = []
            out = _rows(packer.emitted, False, now)
            left = _rows([(None, w[1]) for w in packer.open], True, now)
            return _batch({k: out[k] + left[k] for k in out})

        for b in batches:
            for group, doc_id, start, ids, doc_tokens in zip(*(b.column(c).to_pylist() for c in
                                                                 ("group", "doc_id", "start", "ids", "doc_tokens"))):
                if packer is None or group != now:
                    if packer is not None:
                        yield close()
                    now = group
                    packer = Packer(capacity, open_windows, (1 << 62) - (level << 44) + (group << 20))
                packer.add(doc_id, start, np.asarray(ids, dtype=np.int64), doc_tokens)
        if packer is not None:
            yield close()
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS,
         merge_fan_in: int = MERGE_FAN_IN, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in windows: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are the tokenizer's (``add_special_tokens=False``, special strings as the library
    does by default) and then ``end_id``; a null or empty text is the end id alone. Every id lies in
    exactly one piece; ``start`` counts the document's ids before the piece, ``offset`` the ids before
    it in its sequence (gapless from 0), ``doc_tokens`` the document's ids. Sequences hold at most
    ``capacity`` ids and are padded to it; only the last windows of the final merge are not full.
    Rows with equal or null ``doc_id`` are packed as the separate documents they are. Other columns
    are ignored. Empty input: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = stored(docs.mapInArrow(_pack_documents(tokenizer_path, capacity, open_windows, end_id), PIECE),
                   "packed")
    done = [first.filter(~F.col("leftover"))]
    left, level = first.filter(F.col("leftover")), 1
    while True:
        parts = left.agg(F.max("part")).first()[0]
        final = parts is None or parts < merge_fan_in
        group = F.lit(0).cast("long") if final else F.floor(F.col("part") / merge_fan_in).cast("long")
        merged = stored(
            left.withColumn("group", group).repartition(max(1, int((parts or 0) // merge_fan_in) + 1), "group")
            .sortWithinPartitions("group", "part", "doc_id", "start")
            .mapInArrow(_merge(capacity, open_windows, level, final), PIECE),
            "packed-merge",
        )
        done.append(merged.filter(~F.col("leftover")))
        left, level = merged.filter(F.col("leftover")), level + 1
        if final:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
