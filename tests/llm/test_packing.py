"""Packing against the tokenizer run on each text: every id in one piece, windows gapless and bounded."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trendlab.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, capacity):
    tok = Tokenizer.from_file(PATH)
    expected = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1]) for _, t, *_ in docs]
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    # documents of one id are told apart by their pieces' starts: group by (doc_id, run from 0)
    by_id = {}
    for (doc_id, *_), ids in zip(docs, expected):
        by_id.setdefault(doc_id, []).append(ids)
    for doc_id, all_ids in by_id.items():
        got = sorted(pieces[doc_id], key=lambda r: (r.doc_tokens, r.start))
        assert sum(r.length for r in got) == sum(len(i) for i in all_ids)
        assert sorted(r.doc_tokens for r in got if r.start == 0) == sorted(len(i) for i in all_ids)
        crcs = sorted(r.ids_crc32 for r in got)
        want = []
        for ids in all_ids:
            want += [zlib.crc32(ids[r.start:r.start + r.length].astype("<u4").tobytes())
                     for r in got if r.doc_tokens == len(ids) and r.start < len(ids)]
        assert set(crcs) <= set(want)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for ps in seqs.values():
        ps.sort(key=lambda r: r.offset)
        assert [r.offset for r in ps] == list(np.cumsum([0] + [r.length for r in ps[:-1]]))
        assert sum(r.length for r in ps) <= capacity
    fills = sorted(sum(r.length for r in ps) for ps in seqs.values())
    assert all(f == capacity for f in fills[1:])  # only one window is not full
    return rows


@pytest.mark.parametrize("capacity,fan_in", [(2048, 32), (64, 2)])
def test_packing(spark, docs, awkward, capacity, fan_in):
    rows = packing.pack(docs, PATH, capacity=capacity, merge_fan_in=fan_in).collect()
    check(rows, awkward, capacity)


def test_packing_unique_ids(spark, awkward):
    docs = [(i, *r[1:]) for i, r in enumerate(awkward)]
    from tests.llm.conftest import DOCS
    rows = packing.pack(spark.createDataFrame(docs, DOCS).repartition(6), PATH, capacity=50, merge_fan_in=2).collect()
    tok = Tokenizer.from_file(PATH)
    for i, t, *_ in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1])
        got = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in got] == list(np.cumsum([0] + [r.length for r in got[:-1]]))
        assert sum(r.length for r in got) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].astype("<u4").tobytes()) for r in got)
    check(rows, docs, 50)


def test_packing_empty(spark, no_docs):
    assert packing.pack(no_docs, PATH).count() == 0


def test_ids_by_pieces_equal_the_library_and_are_remembered():
    import public_tokenizers
    from trendlab.llm.packing import PieceIds
    from trendlab.llm.token_counts import load_tokenizer

    library = load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    asked = []

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    texts = ["", " ", "a", "a b's c", "Ein Wört, 12 x\n y\n\nz", " a", "a ", "a  b", "a\u0085 b", "a\x1cb c", "<|endoftext|> a <|end", "漢字 é ñ",
             "it's we'll 'tis don't!!! ###", "a\tb \tc", "x" * 5000 + " y " * 3, "  a  b", "ab 12ab3 ab" * 9000]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for remembered in (300_000, 3):
        ids = PieceIds(Counted(), remembered)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in ids(texts)] == expected
    ids = PieceIds(Counted())
    ids(["one two three"])
    asked.clear()
    ids(["one two three two"])
    assert "".join(asked) == "one"  # the first piece; the others are remembered


def test_each_distinct_piece_of_a_batch_is_looked_up_once(monkeypatch):
    from trendlab.llm import token_counts, words

    looked = []
    of = words.Remembered.of
    monkeypatch.setattr(words.Remembered, "of", lambda self, groups: [looked.extend(g) for g in groups] and of(self, groups))
    library = token_counts.load_tokenizer(PATH)
    texts = ["one two, three.\nTwo two" * 300, "two two. three" * 50, "", "two"]
    got = packing.PieceIds(library)(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(looked) == len(set(looked))


@pytest.mark.parametrize("remembered", [600_000, 40])
def test_piece_ids_of_odd_texts_equal_the_library(remembered):
    import random

    from trendlab.llm.token_counts import load_tokenizer

    library, rng = load_tokenizer(PATH), random.Random(7)
    odd = ["a", "S", "'s", "'", "İ", "ß", " ", "  ", "\n", "\r\n", "\t", ".", ",", "?;", "1", "23", "٣", "\u0301", "漢", "\u3000",
           "\u2009", "\xa0", "\x85", "\x1c", "\x01", "\x00", "😀", "<|endoftext|>", "<|", "ब", "한", "ぁ", "я", "\ufeff", "word", "it's"]
    texts = ["".join(rng.choice(odd) + " " * (rng.random() < 0.3) for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(2000)]
    ids = packing.PieceIds(library, remembered)
    for i in range(0, len(texts), 300):
        some = texts[i : i + 300]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids(some)] == [
            library.encode(t, add_special_tokens=False).ids for t in some
        ]
