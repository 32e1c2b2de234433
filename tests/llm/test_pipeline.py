"""The stages of the corpus pipeline against plain Python, on awkward rows."""

import hashlib
from collections import Counter
from itertools import combinations

import corpus_pipeline
from trendlab.llm import language

from .conftest import DOCS
from .test_texts import components, shingles


def document(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "key", 7, "id", 9)


def brute_survivors(rows):
    """Distinct rows: one of each group of linked ones, and all without words."""
    rows = list(dict.fromkeys(rows))
    sets = [shingles(r[1], 5) for r in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    best = {}
    for row, x in zip(rows, components(len(rows), links)):
        rank = (row[0] is None, row[0] or 0, hashlib.md5((row[1] or "").encode()).digest())
        if x not in best or rank < best[x][0]:
            best[x] = rank, row
    return Counter(row for _, row in best.values())


def test_near_dedup(spark, docs, awkward):
    got = Counter(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect()))
    columns = lambda c: Counter({(k[0], k[1]): n for k, n in c.items()})
    assert columns(got) == columns(brute_survivors(awkward)) and sum(got.values()) == len(columns(got))


def test_near_dedup_of_null_and_shared_ids(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [
        document(None, "a text of its own that nothing else resembles"),
        document(None, "one more text without an id that is unique here"), document(None, "one more text without an id that is unique here"),
        document(None, long), document(None, long + " end"),  # linked, none has an id
        document(5, "words of the first text under a shared number"),
        document(5, " ".join(f"x{i}" for i in range(60)) + " tail"), document(3, " ".join(f"x{i}" for i in range(60))),
        document(8, " ".join(f"y{i}" for i in range(60)) + " tail"), document(8, " ".join(f"y{i}" for i in range(60))),
        document(None, " ".join(f"y{i}" for i in range(60))), document(None, None), document(9, None), document(None, "  "),
    ]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = Counter(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect()))
    assert got == brute_survivors(rows) and sum(got.values()) == 9


def lettered(rows):
    return Counter(r for r in rows if r[1] and any(c.isalpha() for c in r[1]))


def test_language_id_without_labels(spark, docs, awkward):
    bare = [(*r[:2], None, *r[3:]) for r in awkward]
    held = {r["doc_id"] for r in docs.filter(language.held_out("doc_id")).collect()}
    assert held
    labelled = [(*r[:2], "en" if r[0] in held else None, *r[3:]) for r in awkward]
    for rows in (bare, labelled):
        df = spark.createDataFrame(rows, DOCS)
        assert language.fit(df) is None
        assert Counter(map(tuple, corpus_pipeline.language_id(spark, df, "").collect())) == lettered(rows)


def test_language_id_fills_in_missing_labels(spark):
    sounds = {"aa": "the ing and of ", "bb": "der ung sch ein "}
    rows = [document(i, sounds["ab"[i % 2] * 2] * 6, "ab"[i % 2] * 2 if i % 5 else None) for i in range(60)]
    rows += [document(100, "12 34", None), document(None, sounds["aa"] * 6, None), document(101, sounds["aa"], "zz")]
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter(map(tuple, corpus_pipeline.language_id(spark, docs, "").collect()))
    full = [(*r[:2], r[2] or ("aa" if r[1].startswith("the") else "bb"), *r[3:]) for r in rows if r[0] != 100]
    assert got == Counter(full)


def test_no_documents(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
