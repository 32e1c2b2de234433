"""Token counts of whole texts, huge ones by overlap resynchronisation.

A huge text is encoded in overlapping windows with offsets. Two neighbouring windows are spliced at a
position in their overlap where both have a token boundary and which is proven stable: a space
between two characters that are not white space. The byte-level pre-tokenizer always starts a new
pre-token there, whatever comes before or after, and no special string holds a space. Where an
overlap has no such position the left window grows until there is one.

Ordinary texts are cut at the same stable positions, and a worker remembers the count of each piece,
so that a frequent word is encoded once per worker and not once per occurrence.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import LETTERS, NUMBERS, Remembered, is_plain

#: Characters of a window and of the first overlap; longer texts than a window go by windows.
WINDOW, OVERLAP = 1 << 16, 1 << 10
#: Pieces a worker remembers before it starts afresh; bounds its memory, not the result.
REMEMBERED = 500_000
#: White space to Python, but not to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f\x85]")
#: Stands for a piece that begins or ends with white space, where a cut is not stable.
_UNSTABLE = 1 << 40


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _starts(tokenizer, text: str, at: int) -> np.ndarray:
    encoding = tokenizer.encode(text, add_special_tokens=False)
    return np.fromiter((s for s, _ in encoding.offsets), np.int64, len(encoding)) + at


def _meeting(text: str, left: np.ndarray, right: np.ndarray, begin: int, end: int) -> int | None:
    """The first stable position inside the overlap at which both windows start a token."""
    for p in np.intersect1d(left[(left > begin) & (left < end - 1)], right).tolist():
        if text[p] == " " and not text[p - 1].isspace() and not text[p + 1].isspace():
            return p
    return None


def count_windows(tokenizer, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, encoded in overlapping windows."""
    total, cut, end = 0, 0, min(window, len(text))
    left = _starts(tokenizer, text[:end], 0)
    begin = max(end - overlap, 1)
    while end < len(text):
        right_end = min(begin + window, len(text))
        grown = end
        p = None
        if right_end > end:
            right = _starts(tokenizer, text[begin:right_end], begin)
            while (p := _meeting(text, left, right, begin, min(grown, right_end))) is None and grown < right_end:
                grown = min(grown + (grown - begin), right_end)
                left = _starts(tokenizer, text[cut:grown], cut)
        if p is None:  # the windows agree nowhere: the left one swallows the right one
            end = min(right_end + window, len(text))
            left = _starts(tokenizer, text[cut:end], cut)
        else:
            total += int(np.searchsorted(left, p))
            cut, end, left = p, right_end, right[np.searchsorted(right, p) :]
        begin = max(end - overlap, cut + 1)
    return total + len(left)


class PieceCounts:
    """Token counts of texts through counts of their pieces, remembered.

    A piece is what lies between two stable positions, without the space before it. A plain piece is
    cut into the library's pre-tokens, which pieces share; these are encoded by the library, words
    many in a row: a token that holds the space before a word begins that word's tokens. Other pieces
    are given to the library as they are.
    """

    # Fixed value: the pattern by which byte-level vocabularies cut texts.
    CUT = re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
    )

    def __init__(self, tokenizer, window: int = WINDOW, overlap: int = OVERLAP, remembered: int = REMEMBERED):
        self.tokenizer, self.window, self.overlap = tokenizer, window, overlap
        self.begins = np.array([
            (tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(tokenizer.get_vocab_size())
        ])
        self.cuts = Remembered(self._of_cuts, remembered)
        self.pieces = Remembered(self._of_pieces, remembered)

    def _whole(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(texts), 1000):
            out += map(len, self.tokenizer.encode_batch_fast(texts[i : i + 1000], add_special_tokens=False))
        return out

    def _of_cuts(self, cuts: list[str]) -> list[int]:
        words = [c for c in cuts if c[0] == " " and c[1:].isalpha()]
        counts: list[int] = []
        for i in range(0, len(words), 500):
            few = words[i : i + 500]
            ids = self.tokenizer.encode_batch_fast(["".join(few)], add_special_tokens=False)[0].ids
            starts = np.flatnonzero(self.begins[np.array(ids)])
            if len(starts) != len(few):
                raise ValueError("the vocabulary does not mark the beginnings of words as expected")
            counts += np.diff(np.append(starts, len(ids))).tolist()
        of_words = dict(zip(words, counts))
        rest = [c for c in cuts if c not in of_words]
        of_words.update(zip(rest, self._whole(rest)))
        return [of_words[c] for c in cuts]

    def _of_pieces(self, pieces: list[str]) -> list[int]:
        """Counts of pieces with a space before them."""
        cut = [self.CUT.findall(" " + p) if p and is_plain(p) and not _SEPARATORS.search(p) else None for p in pieces]
        known = iter(self.cuts.of([cs for cs in cut if cs is not None]))
        other = iter(self._whole([" " + p for p, cs in zip(pieces, cut) if cs is None]))
        counts = [next(other) if cs is None else sum(next(known)) for cs in cut]
        return [_UNSTABLE if not p or p[0].isspace() or p[-1].isspace() else n for p, n in zip(pieces, counts)]

    def __call__(self, texts: list[str]) -> list[int]:
        split = {i: t.split(" ") for i, t in enumerate(texts) if len(t) <= self.window}
        firsts = self._whole([pieces[0] for pieces in split.values()])
        counts = self.pieces.of([pieces[1:] for pieces in split.values()])
        out = [0] * len(texts)
        late = []
        for (i, pieces), first, rest in zip(split.items(), firsts, counts):
            edge, n = pieces[0], sum(rest)
            if n < _UNSTABLE and (len(pieces) == 1 or (edge and not edge[-1].isspace())):
                out[i] = first + n
            else:
                late.append(i)
        for i, n in zip(late, self._whole([texts[i] for i in late])):
            out[i] = n
        for i, text in enumerate(texts):
            if i not in split:
                out[i] = count_windows(self.tokenizer, text, self.window, self.overlap)
        return out


_WORKER: dict[tuple, PieceCounts] = {}


def _count(path: str, window: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, window, overlap)
        if key not in _WORKER:
            _WORKER[key] = PieceCounts(load_tokenizer(path), window, overlap)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(_WORKER[key](texts), pa.int64())],
                    ["id", "n_bytes", "n_tokens"],
                )

    return run


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    window: int = WINDOW,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for every row of ``docs``, as the tokenizer's library counts.

    No begin, end or other tokens are added; special strings inside a text count as the library takes
    them by default.

    * Null text counts as empty: no bytes, no tokens. Null ids and repeated rows keep a row each.
    * Texts of any length are counted whole. Nothing is shuffled.
    * An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(_count(tokenizer_path, window, overlap), f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
