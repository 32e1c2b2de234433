"""Token ids in directly addressable codes.

Every id is split into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id,
level 1 the second chunk of those that have one, and so on; a bitmap on each level marks the ids that
go on, and a directory holds the number of marks before each block of the bitmap. The place of an id
on the next level is the rank of its mark, so any token is read by one look per level and no block is
ever decoded.

A file set is a Parquet table, so that Spark can write and read it in any store: rows of ``segment``
hold the codes of whole documents in ascending id order (a document longer than a segment goes on in
the next), rows of ``document`` say where each document lies.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import shared_dir, stored
from .token_counts import load_tokenizer
from .words import CutIds, after_word, is_plain

#: Bits of a bitmap between two entries of its rank directory.
_BLOCK = 512
#: Ids after which a segment is closed.
SEGMENT = 1 << 18
#: Words that each of a worker's two generations remembers; bounds its memory, not the result.
REMEMBERED = 600_000
#: Between words that go to the library in a row; a pre-token of its own.
_APART = "\x01"
#: White space that ends a word wherever it stands, and the lower-case form of ASCII bytes with all of it as spaces.
_SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
_LOWER = np.where(_SPACE, ord(" "), np.frombuffer(bytes(range(256)).lower(), np.uint8)).astype(np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """The directly addressable codes of ``ids`` (unsigned 32-bit)."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 255
        padded = np.zeros(-(-len(rest) // _BLOCK) * _BLOCK, bool)
        padded[: len(rest)] = more
        ranks = np.concatenate(([0], np.cumsum(padded.reshape(-1, _BLOCK).sum(axis=1))))[:-1].astype("<u4")
        bits = np.packbits(padded, bitorder="little").tobytes()
        levels.append((len(rest), (rest & 255).astype(np.uint8).tobytes(), bits, ranks.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = struct.pack("<4sII", b"DAC1", len(ids), len(levels)) + b"".join(struct.pack("<I", n) for n, *_ in levels)
    return head + b"".join(part for _, *parts in levels for part in parts)


class Packed:
    """A segment as ``pack`` wrote it: ``codes[i]`` reads one token, ``ids(a, b)`` a run."""

    def __init__(self, data: bytes):
        magic, self.size, levels = struct.unpack_from("<4sII", data)
        if magic != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        counts = struct.unpack_from(f"<{levels}I", data, 12)
        at, self.levels = 12 + 4 * levels, []
        for n in counts:
            blocks = -(-n // _BLOCK)
            self.levels.append((
                np.frombuffer(data, np.uint8, n, at),
                np.frombuffer(data, np.uint8, blocks * _BLOCK // 8, at + n),
                np.frombuffer(data, "<u4", blocks, at + n + blocks * _BLOCK // 8),
            ))
            at += n + blocks * (_BLOCK // 8 + 4)

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Marks before place ``i``."""
        block = i // _BLOCK
        inside = np.unpackbits(bits[block * _BLOCK // 8 : i // 8 + 1], bitorder="little")
        return int(ranks[block]) + int(inside[: i - block * _BLOCK].sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def ids(self, start: int, end: int) -> np.ndarray:
        """Tokens ``start`` to ``end``: on each level they are a run, which two ranks bound."""
        out, where = np.zeros(end - start, "<u4"), np.arange(end - start)
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            marks = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start].astype(bool)
            where = where[marks]
            if len(where):
                start = self._rank(bits, ranks, start)
                end = start + len(where)
        return out


class WordIds(CutIds):
    """Ids of texts through the ids of their words, remembered as bytes.

    White space ends a word for this tokenizer and is dropped, so a text's ids are those of its words
    in turn; a stop after a letter or number begins a pre-token. Plain texts are lower-cased before, as
    the tokenizer would do. Of plain words many in a row go to the library, where the last piece of each
    is marked as the end of a word; other words are set apart by a control character between them.
    """

    def __init__(self, tokenizer, remembered: int = REMEMBERED):
        super().__init__(tokenizer, remembered)
        self.ends = np.array([
            (tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(tokenizer.get_vocab_size())
        ])
        apart = tokenizer.encode(_APART, add_special_tokens=False).ids
        #: The id between words; without one such id, these words go to the library one by one.
        self.apart = apart[0] if len(apart) == 1 else None

    def cut(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Rows with a letter from PLAIN on, or what may be a special string, stay as they are.
        other = data > 0xC4
        other[:-1] |= (data[:-1] == 0xC4) & (data[1:] >= 0xB0)
        other[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        lower = _LOWER[data]
        for row in np.unique(np.searchsorted(rows, np.flatnonzero(other), "right") - 1).tolist():
            lower[rows[row] : rows[row + 1]] = data[rows[row] : rows[row + 1]]
        return lower, _SPACE[data] | after_word(data)

    def _words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stops = np.flatnonzero(self.ends[ids]) + 1
        return np.append(0, stops[:-1])[: len(stops)], stops

    def encoded(self, pieces: list[str]) -> list[bytes]:
        known: dict[str, bytes] = {}
        words = [p.strip(" \t\n\v\f\r") for p in pieces]
        plain = [w for w in words if w.isalpha() and is_plain(w)]
        known.update(zip(plain, self.joined(plain, " ", self._words)))
        rest = [w for w in words if w not in known]
        apart = [w for w in rest if w and self.apart is not None and _APART not in w and "<|" not in w]
        known.update(zip(apart, self.joined(apart, f" {_APART} ", lambda ids: self.between(ids, self.apart))))
        rest = [w for w in rest if w not in known]
        known.update(zip(rest, self.whole(rest)))
        return [known[w] for w in words]


_ROW = pa.schema([
    ("kind", pa.string()), ("part", pa.int32()), ("place", pa.int64()), ("first", pa.int64()),
    ("n", pa.int64()), ("doc_id", pa.int64()), ("data", pa.binary()),
    ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
])
_SCHEMA = (
    "kind string, part int, place long, first long, n long, doc_id long, data binary, "
    "docs array<long>, lengths array<long>"
)
_WORKER: dict[str, WordIds] = {}


def _write(path: str, end_id: int, segment: int):
    """Rows of the file set from texts in order. ``place`` numbers documents and segments of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKER:
            _WORKER[path] = WordIds(load_tokenizer(path))
        part, end = TaskContext.get().partitionId(), np.uint32(end_id)
        first = place = segments = started = 0
        held: list[tuple[int, np.ndarray]] = []

        def closed() -> dict:
            nonlocal segments, started
            ids = np.concatenate([x for _, x in held])
            row = {"kind": "segment", "part": part, "place": segments, "first": started, "n": len(ids), "doc_id": None,
                   "data": pack(ids), "docs": [p for p, _ in held], "lengths": [len(x) for _, x in held]}
            segments, started = segments + 1, started + len(ids)
            held.clear()
            return row

        size = 0
        for whole in batches:
            for batch, encoded in _WORKER[path].batches(whole):
                rows = []
                for doc, ids in zip(batch.column("id").to_pylist(), encoded):
                    ids = np.append(ids, end)
                    rows.append({"kind": "document", "part": part, "place": place, "first": first, "n": len(ids), "doc_id": doc})
                    for i in range(0, len(ids), segment):
                        held.append((place, ids[i : i + segment]))
                        size += len(held[-1][1])
                        if size >= segment:
                            rows.append(closed())
                            size = 0
                    place, first = place + 1, first + len(ids)
                yield pa.RecordBatch.from_pylist(rows, _ROW)
        if held:
            yield pa.RecordBatch.from_pylist([closed()], _ROW)

    return run


def write_codes(
    docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 1, segment: int = SEGMENT,
) -> None:
    """Encode ``docs`` and write the file set ``out`` in ascending id order.

    * Null text counts as empty and is the end id alone. Null ids come first; repeated rows are kept.
    * Ids of equal rank are in the order of their texts. An empty table gives an empty file set.
    * A document of any length is written whole, over as many segments as it needs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    rows.mapInArrow(_write(tokenizer_path, end_id, segment), _SCHEMA).write.partitionBy("kind").option(
        "compression", "none"
    ).parquet(out)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stored segment: which part of which document it holds, with that part's checksum."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
            codes, at, out = Packed(one["data"]), 0, []
            data = memoryview(codes.ids(0, codes.size).tobytes())
            for place, n in zip(one["docs"], one["lengths"]):
                crc = zlib.crc32(data[4 * at : 4 * (at + n)])
                out.append({"part": one["part"], "doc": place, "place": one["place"], "n": n, "crc": crc})
                at += n
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("part", pa.int32()), ("doc", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()),
            ]))


def _times(matrix: list[int], vector: int) -> int:
    total = i = 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector, i = vector >> 1, i + 1
    return total


def crc32_combine(a: int, b: int, length: int) -> int:
    """CRC-32 of two byte strings in a row from theirs and the length of the second.

    Appending a zero bit is a linear map over the 32 bits; its powers by squaring append ``length``
    zero bytes to ``a``.
    """
    step = [0xEDB88320] + [1 << i for i in range(31)]
    bits = 8 * length
    while bits:
        if bits & 1:
            a = _times(step, a)
        step, bits = [_times(step, x) for x in step], bits >> 1
    return a ^ b


@F.udf(T.LongType())
def _whole_crc(pieces):
    crc = 0
    for piece in pieces:
        crc = crc32_combine(crc, piece["crc"], 4 * piece["n"])
    return crc


def read_codes(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a file set, from its files.

    ``start`` counts the ids of all documents before it in ascending order.
    """
    documents = spark.read.schema(_SCHEMA).parquet(path).filter("kind = 'document'")
    segments = spark.read.schema(_SCHEMA).parquet(path).filter("kind = 'segment'")
    # One row per part: the number of its ids, and from that where it begins.
    parts = documents.groupBy("part").agg(F.sum("n").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    pieces = segments.select("part", "place", "data", "docs", "lengths").mapInArrow(
        _pieces, "part int, doc long, place long, n long, crc long"
    )
    whole = stored(pieces.groupBy("part", "doc").agg(
        F.sum("n").alias("n_read"),
        F.array_sort(F.collect_list(F.struct("place", "n", "crc"))).alias("pieces"),
    ), "pieces")
    # Only documents that go over several segments need their checksums combined.
    one = whole.filter("size(pieces) = 1").select("part", "doc", "n_read", F.col("pieces")[0]["crc"].alias("ids_crc32"))
    more = whole.filter("size(pieces) > 1").select("part", "doc", "n_read", _whole_crc("pieces").alias("ids_crc32"))
    whole = one.union(more).withColumnRenamed("doc", "place")
    return (
        documents.join(whole, ["part", "place"], "left").join(parts, "part")
        .select("doc_id", (F.col("base") + F.col("first")).alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32")
    )


def read_tokens(spark, path: str, part: int, positions: list[int]) -> DataFrame:
    """``position, token`` of some places of a part: each looked up directly in its segment."""
    wanted = spark.createDataFrame([(p,) for p in positions], T.StructType([T.StructField("position", T.LongType())]))
    segments = spark.read.schema(_SCHEMA).parquet(path).filter((F.col("kind") == "segment") & (F.col("part") == part))
    held = segments.join(wanted, (F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n")))

    @F.udf(T.LongType())
    def look(data, place):
        return Packed(data)[place]

    return held.select("position", look("data", F.col("position") - F.col("first")).alias("token"))


def encoded_documents(docs: DataFrame, tokenizer_path: str, name: str, **options) -> DataFrame:
    """Write ``docs`` as a file set in the shared folder and read it back."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/{name}"
    write_codes(docs, tokenizer_path, out, **options)
    return read_codes(spark, out)
