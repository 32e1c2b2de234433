"""What a worker remembers about the words of texts while it encodes them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters below this one are their own composed form and belong to one class in every version of
#: Unicode, so that a word of them is cut here as the library would cut it.
PLAIN = "İ"


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(ord(PLAIN))) if unicodedata.category(c)[0] == kind)


#: Insides of character classes: plain letters, plain numbers.
LETTERS, NUMBERS = _class("L"), _class("N")


def is_plain(word: str) -> bool:
    """Only plain letters, and no special string of a vocabulary."""
    return (word.isascii() or max(word) < PLAIN) and "<|" not in word


class Remembered(dict):
    """Answers for words, asked for in bulk. Two generations bound the memory: when the younger one is
    full it becomes the older one, and words that are still in use move on to the next."""

    def __init__(self, answer: Callable[[list[str]], Iterable], limit: int):
        super().__init__()
        self.answer, self.limit, self.older = answer, limit, {}

    def of(self, groups: list[list[str]]) -> list[list]:
        """The answers for the words of each group; new words are put to ``answer`` all at once."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        get = self.get
        found = [list(map(get, words)) for words in groups]
        holes = [i for i, answers in enumerate(found) if None in answers]
        new = {w for i in holes for w, x in zip(groups[i], found[i]) if x is None}
        if self.older:
            known = new & self.older.keys()
            self.update((w, self.older[w]) for w in known)
            new -= known
        fresh = list(new)
        self.update(zip(fresh, self.answer(fresh)))
        for i in holes:
            found[i] = [self[w] if x is None else x for w, x in zip(groups[i], found[i])]
        return found


#: Bytes of text that are cut at once (a longer text alone), and of the longest piece that is remembered.
AT_ONCE, LONGEST = 8 << 20, 64
#: Pieces, and characters of longer texts, that go to the library at once: its encodings hold far more than the ids.
JOINED, ENCODE_CHARS = 400, 1 << 20
#: Pieces whose ids are put in place at once.
PLACED = 1 << 16


def _is_one_of(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


#: ASCII white space, with the separators that only Python takes for it.
SPACE = _is_one_of(b"\t\n\v\f\r\x1c\x1d\x1e\x1f ")
_ALNUM = _is_one_of(bytes(c for c in range(128) if chr(c).isalnum()))
_STOP = _is_one_of(b".,;:!?")


def slices(sizes: list[int] | np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` together (a longer text alone)."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo = i
            total = 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of a text column (null: empty), and where each row begins in it, with the end."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    rows = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if rows[0] == rows[-1]:
        return np.zeros(0, np.uint8), rows - rows[0]
    return np.frombuffer(data, np.uint8)[rows[0] : rows[-1]], rows - rows[0]


def after_word(data: np.ndarray) -> np.ndarray:
    """Marks of stops right after an ASCII letter or number, where every vocabulary begins a pre-token."""
    marks = np.zeros(len(data), bool)
    marks[1:] = _STOP[data[1:]] & _ALNUM[data[:-1]]
    return marks


class CutIds:
    """Ids of texts, as unsigned 32-bit integers, through those of pieces, remembered as bytes.

    Texts are cut where the tokenizer begins a pre-token whatever comes before or after. Arrow finds the
    distinct pieces of many texts; only these are looked up, and those not remembered are encoded by the
    library, many in a row. A text's first piece, which stands without the space before it, and long
    pieces are not remembered.
    """

    def __init__(self, tokenizer, remembered: int):
        self.tokenizer = tokenizer
        self.pieces = Remembered(self.encoded, remembered)

    def cut(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes to encode and marks of those at which a piece begins (rows are cut anyway)."""
        raise NotImplementedError

    def encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces by the library."""
        raise NotImplementedError

    def whole(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts that go to the library one by one."""
        for i in range(0, len(texts), 1000):
            some = texts[i : i + 1000]
            for lo, hi in slices([len(t) for t in some], ENCODE_CHARS):
                for e in self.tokenizer.encode_batch_fast(some[lo:hi], add_special_tokens=False):
                    yield np.array(e.ids, "<u4").tobytes()

    def joined(
        self, pieces: list[str], separator: str, parts: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    ) -> list[bytes]:
        """Ids of pieces that the library gets in a row; ``parts`` gives their beginnings and ends among all ids."""
        out: list[bytes] = []
        for i in range(0, len(pieces), JOINED):
            few = pieces[i : i + JOINED]
            for lo, hi in slices([len(p) for p in few], ENCODE_CHARS):
                text = separator.join(few[lo:hi])
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                begins, ends = parts(ids)
                if len(begins) != hi - lo:
                    raise ValueError("the vocabulary does not mark the borders of pieces as expected")
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip((4 * begins).tolist(), (4 * ends).tolist())]
        return out

    @staticmethod
    def between(ids: np.ndarray, separator: int) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings and ends of what lies between separators."""
        at = np.flatnonzero(ids == separator)
        return np.append(0, at + 1), np.append(at, len(ids))

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where those of each row begin, with the end."""
        data, rows = text_bytes(column)
        if not len(data):
            return np.zeros(0, "<u4"), rows
        data, marks = self.cut(data, rows)
        begun = rows[rows < len(data)]
        marks[begun] = True
        at = np.append(np.flatnonzero(marks), len(data)).astype(np.int32)
        del marks
        alone = np.diff(at) > LONGEST
        alone[np.searchsorted(at, begun.astype(np.int32))] = True
        buffers = pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))
        pieces = pa.StringArray.from_buffers(len(alone), *buffers)
        shared = pa.StringArray.from_buffers(len(alone), *buffers, pa.py_buffer(np.packbits(~alone, bitorder="little")))
        coded = shared.dictionary_encode()
        known = self.pieces.of([coded.dictionary.to_numpy(zero_copy_only=False).tolist()])[0]
        known += self.encoded(pieces.filter(pa.array(alone)).to_numpy(zero_copy_only=False).tolist())
        index = coded.indices.fill_null(0).to_numpy(zero_copy_only=False).copy()
        index[alone] = np.arange(len(coded.dictionary), len(known))
        flat = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begins = np.cumsum(size) - size
        ends = np.zeros(len(index) + 1, np.int64)
        np.cumsum(size[index], out=ends[1:])
        out = np.empty(ends[-1], "<u4")
        for i in range(0, len(index), PLACED):  # little at a time: it stays in the processor's cache
            some = index[i : i + PLACED]
            lo, hi = ends[i], ends[i + len(some)]
            ids = np.repeat(begins[some] - ends[i : i + len(some)] + lo, size[some])
            ids += np.arange(hi - lo)
            out[lo:hi] = flat[ids]
        return out, ends[np.searchsorted(at[:-1], rows.astype(np.int32))]

    def batches(self, batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        """Parts of a batch with the ids of each row."""
        column = batch.column(text)
        for lo, hi in slices(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), AT_ONCE):
            ids, bounds = self.of(column.slice(lo, hi - lo))
            at = bounds.tolist()
            yield batch.slice(lo, hi - lo), [ids[a:b] for a, b in zip(at, at[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, bounds = self.of(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
