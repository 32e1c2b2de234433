"""The operators over texts against plain brute force, on awkward rows and on none."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trendlab.llm import codes, language, minhash, mixing, pieces, pii, secrets, token_counts

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


# ---------------------------------------------------------------- near-duplicates


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < width else zip(*(w[i:] for i in range(width)))) if w else frozenset()


def components(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def brute_duplicates(rows, width):
    sets = [shingles(r[1], width) for r in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = components(len(rows), links)
    low = defaultdict(list)
    for row, x in zip(rows, label):
        low[x].append(row[0])
    out = []
    for row, x, s in zip(rows, label, sets):
        ids = [i for i in low[x] if i is not None]
        c = min(ids) if ids else None
        out.append((row[0], len(s), c, (row[0] == c if row[0] is not None or s else True)))
    return out


def plain(rows):
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, awkward, width):
    got = plain(minhash.near_duplicates(docs, width=width).collect())
    want = Counter()
    for r in brute_duplicates(awkward, width):
        want[r] += 1
    null_ids = lambda c: Counter({k[1:3]: v for k, v in c.items() if k[0] is None})
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert null_ids(got) == null_ids(want)


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Many near copies whose links are not all direct, compared in several blocks of a bucket."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(minhash, "LEAST_WEIGHT", 50)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(30))) for i in range(50)]
    got = plain(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect())
    assert got == plain(brute_duplicates(rows, 4))


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        common = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
        rest = rng.integers(0, 2**63, (2, (1000 - len(common)) // 2), dtype=np.uint64)
        a, b = (minhash.signature(np.concatenate((common, r)), 400) for r in rest)
        assert abs((a == b).mean() - share) < 0.09


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n)) for n in (0, 5, 20, 30, 1)]
    got = minhash.common_counts(sets)
    for i, j in combinations(range(5), 2):
        assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


# ---------------------------------------------------------------- tokens


def test_token_counts(docs, awkward):
    tok = token_counts.load_tokenizer(BYTES)
    got = Counter(map(tuple, token_counts.token_counts(docs, BYTES, window=3000, overlap=64).collect()))
    want = Counter()
    for r in awkward:
        n = len(tok.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 1024] += 1
    assert got == want


def test_windows_meet_anywhere():
    tok = token_counts.load_tokenizer(BYTES)
    rng = random.Random(3)
    letters = "abcde  \n.'é日<|endoftext|>12"
    for _ in range(150):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 400)))
        assert token_counts.count_windows(tok, text, 60, 8) == len(tok.encode(text, add_special_tokens=False))
    run = "z" * 900 + " end"
    assert token_counts.count_windows(tok, run, 100, 10) == len(tok.encode(run, add_special_tokens=False))


def test_packed_codes():
    rng = np.random.default_rng(2)
    for ids in ([], [0], [255, 256, 2**32 - 1], rng.integers(0, 70_000, 3000), rng.integers(0, 2**32, 700)):
        ids = np.array(ids, np.uint32)
        packed = codes.Packed(codes.pack(ids))
        assert [packed[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2)):
            assert packed.ids(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        codes.Packed(codes.pack(np.array([1], np.uint32)))[1]
    with pytest.raises(ValueError):
        codes.Packed(b"nothing of the kind....")


def test_crc32_combine():
    a, b = b"first part", b"and the second " * 50
    assert codes.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert codes.crc32_combine(zlib.crc32(a), 0, 0) == zlib.crc32(a)


@pytest.mark.parametrize("segment", [50, 1 << 18])
def test_codes_round_trip(spark, docs, awkward, tmp_path, segment):
    tok = token_counts.load_tokenizer(WORDS)
    out = str(tmp_path / "codes")
    codes.write_codes(docs, WORDS, out, segment=segment)
    got = sorted((tuple(r) for r in codes.read_codes(spark, out).collect()), key=lambda r: r[1])
    start, want = 0, []
    for r in sorted(awkward, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    stored = spark.read.parquet(out)
    part = stored.filter("kind = 'segment'").first()["part"]
    size = stored.filter(f"kind = 'segment' and part = {part}").agg(F.sum("n")).first()[0]
    looked = {r.position: r.token for r in codes.read_tokens(spark, out, part, [0, size // 2, size - 1]).collect()}
    assert len(looked) == len({0, size // 2, size - 1}) and looked[size - 1] == 1


def test_pieces(docs, awkward, spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = Counter((r.doc_id, tuple(r.ids)) for r in pieces.encode(docs, PIECES).collect())
    assert got == Counter((r[0], tuple(sp.encode(r[1] or ""))) for r in awkward)
    assert all(r.round_trip for r in pieces.encode_and_check(docs, PIECES).collect())
    back = pieces.decode_ids(pieces.encode(docs, PIECES), PIECES).collect()
    assert Counter(map(tuple, back)) == Counter((r[0], (r[1] or "").replace("▁", " ")) for r in awkward)


def test_pieces_of_random_texts():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoder, rng = pieces.Encoder(pieces.Model(PIECES), remembered=50), random.Random(5)
    texts = ["".join(rng.choice(" \n▁abcdethinours.,0199éß日<>\x00") for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    for i in range(0, len(texts), 100):
        for text, ids in zip(texts[i : i + 100], encoder(texts[i : i + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text)


def test_unigram_pass_is_viterbi():
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    ids = {p: i for i, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "aab", "cc"])}
    scores = [-3.0, -3.1, -3.2, -4.0, -4.1, -4.4, -4.6, -5.3, -7.7]
    model = pieces.Model.of(ids, scores, unigram=True)

    def best(word):
        if not word:
            return 0.0
        return max(scores[ids[word[-n:]]] + best(word[:-n]) for n in range(1, 4) if word[-n:] in ids and n <= len(word))

    for word, out in pieces.encode_words(model, list(set(words))):
        found = np.frombuffer(out, "<u4").tolist()
        assert "".join(model.piece[i] for i in found) == word
        assert abs(sum(scores[i] for i in found) - best(word)) < 1e-9


# ---------------------------------------------------------------- language


def test_language(spark):
    rng = random.Random(7)
    sounds = {"aa": ["the", "ing", "and", "of"], "bb": ["der", "ung", "sch", "ein"], "cc": ["que", "eau", "les", "oi"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(sounds))
        text = " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 150)))
        rows.append((i, text, lang if i % 9 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    assert sum(got[i].lang_pred == lang for i, _, lang in held if lang) >= 0.97 * sum(lang is not None for *_, lang in held)
    assert all(0 <= r.score <= 1 for r in got.values())
    # Labels of held-out rows teach nothing.
    other = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    assert np.array_equal(language.fit(other).weights, model.weights)


def test_language_folds_like_the_network():
    rng = np.random.default_rng(8)
    windows = [("x", "".join(map(chr, rng.integers(97, 110, 200)))) for _ in range(20)] + [("y", "".join(map(chr, rng.integers(108, 122, 200)))) for _ in range(20)]
    model = language.train(windows, steps=30)
    texts = [bytes(rng.integers(97, 122, n).astype(np.uint8)) for n in (1, 255, 256, 257, 900)]
    got = language.Predictor(model)(texts)
    for text, row in zip(texts, got):
        total = np.zeros(2)
        for at in range(0, len(text), language.WINDOW):
            part = text[at : at + language.WINDOW + 3]
            e = model.embedding[np.frombuffer(part + bytes(language.WINDOW + 3 - len(part)), np.uint8)]
            hidden = [
                max(e[t : t + w].ravel() @ f[:, k] for t in range(language.WINDOW))
                for w, f in zip(language.WIDTHS, model.filters) for k in range(language.FILTERS)
            ]
            z = np.array(hidden) @ model.weights + model.bias
            p = np.exp(z - z.max())
            total += p / p.sum() * min(language.WINDOW, len(text) - at)
        assert np.allclose(row, total / len(text), atol=1e-5)


def test_language_edges(docs, awkward, no_docs):
    model = language.fit(docs)
    got = language.predict(docs, model).collect()
    assert len(got) == len(awkward)
    letters = {r[0]: bool(r[1]) and any(c.isalpha() for c in r[1]) for r in awkward if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not letters[r.doc_id])
    stay = language.identified(docs, model)
    assert stay.columns == docs.columns and stay.count() == sum(bool(r[1]) and any(c.isalpha() for c in r[1]) for r in awkward)
    assert language.fit(no_docs) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


# ---------------------------------------------------------------- spans


def spans_of(text, kinds):
    out = []
    for place, (kind, pattern, valid) in enumerate(kinds):
        out += [(m.start(), place, m.end(), kind) for m in re.finditer(pattern, text or "") if valid(m)]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


SECRETS = [
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def luhn(digits):
    worth = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in worth) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def random_texts(letters, n, seed):
    rng = random.Random(seed)
    return [(10_000 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))) for i in range(n)]


def test_secrets(spark, docs, awkward):
    rows = [(r[0], r[1]) for r in awkward] + random_texts(["password", "TOKEN", "api_key", "=", ":", " ", "'", "\"", "abc", "AKIA", "Z9", "0f", "é"], 600, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, ledger = secrets.find_secrets(df)
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.report(found).collect())
    want = Counter()
    for i, text in rows:
        s = spans_of(text, SECRETS)
        want[(i, *(sum(x[3] == k for x in s) for k, *_ in SECRETS), digest(s))] += 1
    assert got == want
    assert secrets.find_secrets(docs)[0].count() == len(awkward)


def test_ledger_scans_only_what_is_new(spark):
    one = spark.createDataFrame([(1, "password=abcdef"), (2, "password=abcdef"), (3, "nothing")], "doc_id long, text string")
    found, ledger = secrets.find_secrets(one)
    assert ledger.count() == 2 and found.filter("size(spans) = 1").count() == 2
    two = one.union(spark.createDataFrame([(4, "token: zzzzzzz"), (5, "nothing")], one.schema))
    found, grown = secrets.find_secrets(two, ledger=ledger)
    assert grown.count() == 3
    assert {r.id: len(r.spans) for r in found.collect()} == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}
    # A new version of one rule makes every blob be scanned again by that rule alone.
    newer = [r._replace(version=2, pattern="noth[a-z]{3,}", possible=None) if r.kind == "access" else r for r in secrets.rules()]
    found, again = secrets.find_secrets(two, ledger=grown, wanted=newer)
    fresh = again.join(grown, ["blob", "rules"], "left_anti").collect()
    assert len(fresh) == 3 and all(r.rules == ["access@2"] for r in fresh)
    assert {r.id: [s.kind for s in r.spans] for r in found.collect()} == {1: ["assign"], 2: ["assign"], 3: ["access"], 4: ["assign"], 5: ["access"]}


def test_personal_data(spark, docs, awkward):
    rows = [(r[0], r[1]) for r in awkward] + random_texts("0123456789012345678901234567 .-+()@ab_%é,\n", 1500, 10)
    rows += [(20_000 + i, t) for i, t in enumerate(["a@b.c_x@e.f", "1.2.3.4.5.6.7.8", "9" * 5000, "1 " * 4000, "a" * 30_000, "256.1.1.1 001.002.003.004"])]
    found, _ = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.report(found).collect())
    want = Counter()
    for i, text in rows:
        s = spans_of(text, PERSONAL)
        want[(i, *(sum(x[3] == k for x in s) for k, *_ in PERSONAL), digest(s))] += 1
    assert got == want
    assert pii.find_personal_data(docs)[0].count() == len(awkward)


def test_masking(spark, docs, awkward):
    rows = [(1, "write bob@x.org, é call +1 (377) 555-0271 now"), (2, "clean text 12"), (3, None), (4, "a@b.c_x@e.f"), (5, "ssn 123-45-6789.")]
    got = {r.doc_id: r.text for r in pii.masked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "write <email>, é call <phone> now", 2: "clean text 12", 3: None, 4: "<email><email>", 5: "ssn <ssn>."}
    out = pii.masked(docs)
    assert out.columns == docs.columns and out.count() == len(awkward)


def test_reliability_is_estimated():
    """Votes drawn from known reliabilities give these back."""
    rng = random.Random(11)
    votes = Counter()
    for _ in range(20_000):
        y = rng.random() < 0.4
        said = tuple(int(y) if rng.random() < r else int(not y) for r in (0.95, 0.8, 0.7))
        votes["ssn", said] += 1
    _, reliability = pii.estimate([(k, v, n) for (k, v), n in votes.items()])
    for r, true in zip(reliability, (0.95, 0.8, 0.7)):
        assert abs(r["for_personal"] - true) < 0.03 and abs(r["against_other"] - true) < 0.03


# ---------------------------------------------------------------- mixing


def test_targets(spark):
    rng = random.Random(12)
    for _ in range(3):
        sizes = {s: rng.randint(0, 900) for s in "abcdefgh"} | {None: rng.randint(1, 900)}
        order = sorted((s for s in sizes if s is not None)) + [None]
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
        while left > 1e-9 and open_:
            total, spare = sum(weight[s] for s in open_), 0.0
            for s in list(open_):
                target[s] += left * weight[s] / total
                if target[s] >= 2 * sizes[s]:
                    spare += target[s] - 2 * sizes[s]
                    target[s] = 2.0 * sizes[s]
                    open_.discard(s)
            left = spare
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got.keys() == target.keys() and all(abs(got[s] - target[s]) < 1e-6 for s in got)


def test_mix(spark, docs, awkward):
    rng = random.Random(13)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice("aaaabc")) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per = mixing.copies(df).collect()
    assert all(r.copies in (0, 1, 2) for r in per)
    for source in "abc":
        own = [r for r in per if r.source == source]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 0.02 * own[0].target + 60
    out = Counter(r.doc_id for r in mixing.mix(df).collect())
    assert out == Counter({r.id: r.copies for r in per if r.copies}) and mixing.mix(df).columns == df.columns
    again = Counter(map(tuple, mixing.copies(df.repartition(7)).collect()))
    assert again == Counter(map(tuple, per))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixing.copies(docs).count() == len(awkward)


def test_word_count(docs, awkward):
    got = Counter(map(tuple, docs.select("doc_id", mixing.word_count(F.col("text"))).collect()))
    assert got == Counter((r[0], len((r[1] or "").encode().split())) for r in awkward)


# ---------------------------------------------------------------- empty tables


def test_empty_tables(spark, no_docs, tmp_path):
    assert minhash.near_duplicates(no_docs).count() == 0
    assert token_counts.token_counts(no_docs, BYTES).count() == 0
    assert language.predict(no_docs, None).count() == 0
    assert secrets.find_secrets(no_docs)[0].count() == 0
    assert mixing.copies(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    assert pii.find_personal_data(no_docs)[0].count() == 0 and pii.masked(no_docs).count() == 0
    assert pieces.encode(no_docs, PIECES).count() == 0
    codes.write_codes(no_docs, WORDS, str(tmp_path / "none"))
    assert codes.read_codes(spark, str(tmp_path / "none")).count() == 0


def test_words_in_use_are_kept_when_sentence_piece_memory_is_full(monkeypatch):
    from trendlab.llm import pieces

    learned = []
    encode_words = pieces.encode_words

    def counted(model, words):
        learned.extend(words)
        return encode_words(model, words)

    monkeypatch.setattr(pieces, "encode_words", counted)
    model = pieces.Model.of({"▁": 0, "a": 1, "b": 2, "▁a": 3, "ab": 4}, [-3.0, -4.0, -5.0, -1.0, -2.0], unknown=9)
    small, large = pieces.Encoder(model, remembered=2), pieces.Encoder(model)
    texts = ["ab ba aa\nb", "ab a", "ab ba", "ab bb\nb", "ab b"]
    assert [small([t]) for t in texts] == [large([t]) for t in texts]
    learned.clear()
    again = pieces.Encoder(model, remembered=2)
    for t in texts:
        again([t])
    assert learned.count("▁ab") == 1


def test_each_distinct_word_of_a_batch_is_looked_up_once(monkeypatch):
    from trendlab.llm import words

    looked = []
    of = words.Remembered.of
    monkeypatch.setattr(words.Remembered, "of", lambda self, groups: [looked.extend(g) for g in groups] and of(self, groups))
    library = token_counts.load_tokenizer(WORDS)
    texts = ["One two, three.\nTwo two " * 300, "two two. three " * 50, "", "two"]
    got = codes.WordIds(library)(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(looked) == len(set(looked))


def test_ids_are_put_in_place_in_little_memory():
    import tracemalloc

    ids = codes.WordIds(token_counts.load_tokenizer(WORDS))
    column = pa.array(["the cat sat on the mat " * 2000] * 50)
    ids.of(column)
    tracemalloc.start()
    try:
        ids.of(column)
        assert tracemalloc.get_traced_memory()[1] < 11 * column.nbytes
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("remembered", [800_000, 40])
def test_word_ids_of_odd_texts_equal_the_library(remembered):
    library, rng = token_counts.load_tokenizer(WORDS), random.Random(7)
    odd = ["a", "S", "'s", "'", "İ", "ß", "É", "h", "H", "\u0331", "\u0301", "\u212a", "ΑΣ", " ", "\n", "\t", ".", ",", "?;", "1", "23", "٣",
           "漢", "\u3000", "\xa0", "\x85", "\x1c", "\x01", "\x00", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|",
           "ब", "ﬁ", "²", "ª", "word", "Word", "it's", "x" * 90]
    texts = ["".join(rng.choice(odd) + " " * (rng.random() < 0.3) for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(2000)]
    ids = codes.WordIds(library, remembered)
    for i in range(0, len(texts), 300):
        some = texts[i : i + 300]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids(some)] == [
            library.encode(t, add_special_tokens=False).ids for t in some
        ]
