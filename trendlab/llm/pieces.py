"""SentencePiece encoding and decoding by a forward pass that words share.

Distinct marked words (a word with the mark of the space before it) are sorted, which is a depth-first
walk of their trie: each word goes on from the state of the prefix it shares with the word before it,
and only the rest of it is computed. The state of a prefix is its best last piece.

For a unigram model the best last piece is Viterbi's: the one with the highest sum of scores. For a
BPE model sums of scores do not give the library's pieces, as merges are greedy; there the last piece
is the one that the merges leave: piece t may follow piece s where merging the letters of both alone
gives back s and t, and for every prefix exactly one piece at its end may follow what comes before.
Both passes read one state per letter of the prefix and extend it by one, so prefixes are shared alike.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
#: Words a worker remembers before it forgets those no longer in use; bounds its memory, not the result.
REMEMBERED = 400_000
_MARKED = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class Model:
    """The pieces of a ``.model`` file and the rule by which one may follow another."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(p.serialized_model_proto())
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("only models that keep texts as they are and mark their first word are supported")
        n = p.get_piece_size()
        self._init(
            {p.id_to_piece(i): i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))},
            [p.get_score(i) for i in range(n)],
            {int(p.id_to_piece(i)[1:-1], 16): i for i in range(n) if p.is_byte(i)},
            p.unk_id(),
            spec.trainer_spec.model_type == proto.TrainerSpec.UNIGRAM,
        )

    def _init(self, ids: dict, scores: list, bytes_: dict, unknown: int, unigram: bool) -> None:
        self.ids, self.scores, self.bytes, self.unknown, self.unigram = ids, scores, bytes_, unknown, unigram
        #: Lengths of the longer pieces that end in two letters, longest first.
        self.lengths: dict[str, list[int]] = {}
        for n, end in sorted({(len(s), s[-2:]) for s in ids if len(s) > 1}, reverse=True):
            self.lengths.setdefault(end, []).append(n)
        self.piece = {i: s for s, i in ids.items()}
        self.low = min((scores[i] for i in ids.values()), default=0.0) - 10.0
        self.known: dict[int, bool] = {}  # answers of ``follows``, by both ids
        self.text = {i: s.replace(MARK, " ").encode() for s, i in ids.items()} | {i: bytes([b]) for b, i in bytes_.items()}
        self.text[unknown] = " ⁇ ".encode()

    @classmethod
    def of(cls, ids: dict, scores: list, bytes_: dict | None = None, unknown: int = 0, unigram: bool = False) -> Model:
        model = cls.__new__(cls)
        model._init(ids, scores, bytes_ or {}, unknown, unigram)
        return model

    def merged(self, letters: list[str]) -> list[str]:
        """What the merges leave of a few letters: the best-scored pair first, the leftmost of equals."""
        while True:
            best = None
            for i in range(len(letters) - 1):
                k = self.ids.get(letters[i] + letters[i + 1])
                if k is not None and (best is None or self.scores[k] > best[0]):
                    best = (self.scores[k], i)
            if best is None:
                return letters
            i = best[1]
            letters = [*letters[:i], letters[i] + letters[i + 1], *letters[i + 2 :]]

    def follows(self, before: int, piece: int) -> bool:
        """May ``piece`` follow ``before`` (-1: begins the word, or comes after an unknown letter)?"""
        parts = [self.piece[piece]] if before < 0 else [self.piece[before], self.piece[piece]]
        answer = self.known[before << 32 | piece] = self.merged(list("".join(parts))) == parts
        return answer

    def fallback(self, letter: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in letter.encode("utf-8", "surrogatepass")]


def encode_words(model: Model, words: list[str]) -> Iterator[tuple[str, bytes]]:
    """``(word, ids)`` of distinct words, in the order of their trie; ids are unsigned 32-bit.

    A word may begin with one mark, but hold none further on.
    """
    find, lengths, known = model.ids.get, model.lengths.get, model.known.get
    before = ""
    last = [-1]  # per depth the id of the last piece, -1 for an unknown letter
    width = [0]
    score = [0.0]
    for word in sorted(words):
        depth, top = 0, min(len(before), len(word))
        while depth < top and before[depth] == word[depth]:
            depth += 1
        del last[depth + 1 :], width[depth + 1 :], score[depth + 1 :]
        for end in range(depth + 1, len(word) + 1):
            found, length, best = -1, 1, score[end - 1] + model.low
            for n in (*lengths(word[end - 2 : end], ()), 1) if end > 1 else (1,):
                if n > end:
                    continue
                k = find(word[end - n : end])
                if k is None:
                    continue
                if model.unigram:
                    total = score[end - n] + model.scores[k]
                    if found < 0 or total > best:
                        found, length, best = k, n, total
                    continue
                earlier = last[end - n]
                may = known(earlier << 32 | k)
                if may or (may is None and model.follows(earlier, k)):
                    found, length = k, n
                    break
            last.append(found)
            width.append(length)
            score.append(best)
        out: list[int] = []
        end = len(word)
        while end:
            if last[end] < 0:
                out.extend(reversed(model.fallback(word[end - 1])))
            else:
                out.append(last[end])
            end -= width[end]
        out.reverse()
        yield word, array("I", out).tobytes()
        before = word


class Encoder:
    """Encodes texts through their distinct marked words, remembered as bytes of ids."""

    def __init__(self, model: Model, remembered: int = REMEMBERED):
        self.model, self.remembered = model, remembered
        self.plain: dict[str, bytes] = {}  # words without a mark
        self.marked: dict[str, bytes] = {}  # words after a mark
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # both, of the generation before
        # A run of marks is merged from the left, as far as there are pieces, unless a word takes one.
        self.runs = {len(s): i for s, i in model.ids.items() if not s.strip(MARK)}
        self.newline = np.array(model.fallback("\n") if "\n" not in model.ids else [model.ids["\n"]], "<u4").tobytes()

    def _learn(self, texts: list[list[list[str]]]) -> None:
        plain: set[str] = set()
        marked: set[str] = set()
        for lines in texts:
            marked.update(*lines)
            plain.update(words[0] for words in lines[1:])
        self._add(plain, marked)

    def _add(self, plain: set[str], marked: set[str]) -> None:
        if len(self.plain) + len(self.marked) > self.remembered:
            self.older = self.plain, self.marked
            self.plain, self.marked = {}, {}
        for words, now, before in zip((plain, marked), (self.plain, self.marked), self.older):
            words.difference_update(now)
            known = words & before.keys()  # words still in use move on
            now.update((w, before[w]) for w in known)
            words -= known
        self.plain.update(encode_words(self.model, list(plain)))
        self.marked.update((w[1:], ids) for w, ids in encode_words(self.model, [MARK + w for w in marked]))

    def _run(self, marks: int) -> bytes:
        out, longest = [], max(self.runs)
        while marks:
            n = next(n for n in range(min(marks, longest), 0, -1) if n in self.runs)
            out.append(self.runs[n])
            marks -= n
        return np.array(out, "<u4").tobytes()

    def _odd(self, text: str) -> bytes:
        """A text with marks in runs, at its end, or of its own."""
        parts = _MARKED.findall(MARK + text.replace(" ", MARK))
        words = [(len(p) - len(p.lstrip(MARK)), p.lstrip(MARK)) for p in parts]
        self._add({w for n, w in words if not n}, {w for n, w in words if n})
        out = []
        alone = np.array([self.model.ids.get(MARK, -1)], "<i8").astype("<u4").tobytes()
        for n, word in words:
            if not n:
                out.append(self.newline if word == "\n" else self.plain[word])
            elif not word:
                out.append(self._run(n))
            elif self.marked[word][:4] == alone:  # the word leaves its mark to the run
                out.append(self._run(n) + self.marked[word][4:])
            else:
                out.append((self._run(n - 1) if n > 1 else b"") + self.marked[word])
        return b"".join(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, unsigned 32-bit little-endian."""
        split: list[list[list[str]] | None] = []
        for text in texts:
            lines = [line.split(" ") for line in text.split("\n")] if MARK not in text and "\r" not in text else None
            if lines and any("" in words for words in lines):
                lines = None
            split.append(lines)
        self._learn([lines for lines in split if lines])
        plain, marked, out = self.plain.__getitem__, self.marked.__getitem__, []
        late = []
        for i, (text, lines) in enumerate(zip(texts, split)):
            if not text:
                out.append(b"")
            elif lines is None:
                out.append(b"")
                late.append(i)
            else:
                parts = list(map(marked, lines[0]))
                for words in lines[1:]:
                    parts.append(self.newline)
                    parts.append(plain(words[0]))
                    parts.extend(map(marked, words[1:]))
                out.append(b"".join(parts))
        for i in late:  # these may make room among the remembered words
            out[i] = self._odd(texts[i])
        return out


def decode(model: Model, ids: bytes) -> str:
    """The text of ids: marks become spaces, bytes are put together, the first mark goes."""
    data = b"".join(map(model.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_WORKER: dict[str, Encoder] = {}


def _run_encoder(path: str, checked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKER:
            _WORKER[path] = Encoder(Model(path))
        encoder = _WORKER[path]
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                encoded = encoder(texts)
                if not checked:
                    flat = pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32))
                    offsets = np.concatenate(([0], np.cumsum([len(e) // 4 for e in encoded]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, flat)], ["id", "ids"])
                    continue
                same = [decode(encoder.model, e) == t.replace(MARK, " ") for e, t in zip(encoded, texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(e) // 4 for e in encoded], pa.int64()),
                     pa.array([zlib.crc32(e) for e in encoded], pa.int64()), pa.array(same, pa.bool_())],
                    ["id", "n_tokens", "ids_crc32", "round_trip"],
                )

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids`` (array of int) for every row of ``docs``, without begin or end ids.

    * Null text counts as empty and has no ids. Null ids and repeated rows keep a row each.
    * Texts of any length are encoded whole. Nothing is shuffled.
    * An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_run_encoder(model_path, False), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def encode_and_check(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_crc32, round_trip``: the ids' checksum, and whether decoding gives the text back.

    ``ids_crc32`` is over the ids as unsigned 32-bit little-endian numbers. A mark letter in a text is
    the same as a space to the model. Edge cases as in ``encode``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    checked = rows.mapInArrow(_run_encoder(model_path, True), f"id {kind}, n_tokens long, ids_crc32 long, round_trip boolean")
    return checked.withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` from ``id, ids``; null ids give null."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_path)
        for batch in batches:
            texts = [None if x is None else decode(model, np.array(x, "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
