"""Personal data by weak supervision, in SQL expressions alone.

Patterns propose candidate spans. Labelers of three sorts vote on each (1 personal, 0 not, -1 no
opinion): the strict format, gazetteers (mail domains, issuers, calling codes, countries) and the words
just before. Votes are counted by pattern of votes, a table that is bounded by the number of kinds and
labelers, not by the texts; expectation-maximisation over it estimates how reliable each labeler is,
and its answers train a logistic classifier of spans. Spans of the four base kinds that pass their
checks always stay; the classifier decides on the others.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored
from .spans import digest, joined, located, of_kinds

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ssn", "iban", "local"]
LABELERS = ["format", "gazetteer", "context"]

# Starts that cannot lead to a match are ruled out by looking behind: a run of digits or of mailbox
# letters matches from its first character or not at all, and possessive runs are never retried.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_MAIL_ENDS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "nl", "ch", "at", "be", "eu", "us"]
_COUNTRIES = ["AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
_BEFORE = r"(?i)\b(?:e-?mail|mail|tel|telephone|phone|call|mobile|cell|fax|contact|card|visa|ssn|social security|iban|account|konto|ip|host|t.l.phone|telefon|tel.fono|correo|tarjeta|carte|karte)\b[^.!?]{0,12}$"
_NOT_BEFORE = r"(?i)\b(?:version|isbn|issn|order|invoice|part|build|ref|serial|section|chapter|page)\b[^.!?]{0,12}$"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Doubling every second digit from the right, the digit sum is a multiple of ten."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(each, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _iban(hit: Column) -> Column:
    """The first four letters moved to the end and letters read as 10 to 35, the number is 1 modulo 97."""
    compact = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    each = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (F.when(c.rlike("[0-9]"), rest * 10).otherwise(rest * 100) + value) % 97

    return F.aggregate(each, F.lit(0), step) == 1


def _format(kind: str, hit: Column) -> Column:
    """The strict check of a kind."""
    n = F.length(_digits(hit))
    return {
        "email": F.lit(True),
        "ip": hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": F.when(n.between(14, 19), _luhn(_digits(hit))).otherwise(F.lit(False)),
        "phone": n.between(10, 15),
        "ssn": ~hit.rlike("^(?:000|666|9)|-00-|-0000$"),
        "iban": _iban(hit),
        "local": hit.rlike(r"^\(?[2-9]"),
    }[kind]


def _gazetteer(kind: str, hit: Column) -> Column:
    none = F.lit(-1)
    known = lambda test: F.when(test, 1).otherwise(0)
    return {
        "email": F.when(F.lower(F.element_at(F.split(hit, r"\."), -1)).isin(_MAIL_ENDS), 1).otherwise(none),
        "ip": F.when(hit.rlike(r"^(?:0|10|127|192\.168|255)\."), 0).otherwise(1),
        "card": known(_digits(hit).rlike("^(?:4|5[1-5]|2[2-7]|3[4-8]|6)")),
        "phone": F.when(hit.rlike(r"^\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-8])"), 1).otherwise(none),
        "ssn": none,
        "iban": known(F.substr(hit, F.lit(1), F.lit(2)).isin(_COUNTRIES)),
        "local": none,
    }[kind]


def _context(text: Column, start: Column) -> Column:
    before = F.substr(text, F.greatest(start - 24, F.lit(0)) + 1, F.least(start, F.lit(24)))
    return F.when(before.rlike(_NOT_BEFORE), 0).when(before.rlike(_BEFORE), 1).otherwise(-1)


def _candidate(text: Column, kind: str, place: int):
    def voted(s: Column) -> Column:
        votes = F.array(
            F.when(_format(kind, s["hit"]), 1).otherwise(0),
            _gazetteer(kind, s["hit"]).cast("int"),
            _context(text, s["start"]),
        )
        return F.struct(
            s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), votes.alias("votes"),
        )

    return voted


def with_candidates(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with ``out``: sorted ``start, place, end, kind, votes`` of all candidate spans of a text.

    ``place`` orders the kinds. A candidate of an added kind that touches a valid base span is left out.
    """
    has = F.col(text).rlike("[0-9]")
    when = {"email": F.col(text).contains("@"), "phone": F.col(text).contains("+") & has}
    docs = docs.withColumn(f"_{out}_digit", has)
    for place, kind in enumerate(KINDS):
        name = f"_{out}_{kind}"
        docs = located(docs, text, name, PATTERNS[kind], when.get(kind, F.col(f"_{out}_digit")))
        docs = docs.withColumn(name, F.transform(name, _candidate(F.col(text), kind, place)))
    base = F.filter(F.concat(*(F.col(f"_{out}_{k}") for k in BASE)), lambda s: s["votes"][0] == 1)
    docs = docs.withColumn(f"_{out}_base", base)
    added = F.filter(F.concat(*(F.col(f"_{out}_{k}") for k in KINDS[len(BASE) :])), lambda s: ~F.exists(
        f"_{out}_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    ))
    failed = F.filter(F.concat(*(F.col(f"_{out}_{k}") for k in BASE)), lambda s: s["votes"][0] != 1)
    docs = docs.withColumn(out, F.array_sort(F.concat(F.col(f"_{out}_base"), failed, added)))
    return docs.drop(f"_{out}_digit", f"_{out}_base", *(f"_{out}_{k}" for k in KINDS))


class Classifier(NamedTuple):
    """A logistic model of spans: a weight per kind, and per labeler for its votes -1, 0 and 1."""

    kinds: dict[str, float]
    votes: list[list[float]]
    #: Per labeler the estimated chances of a vote for and against, given a personal span and another.
    reliability: list[dict[str, float]]


def estimate(patterns: list[tuple[str, tuple, int]], rounds: int = 60) -> tuple[list[float], list[dict[str, float]]]:
    """Expectation-maximisation over ``(kind, votes, count)``: each pattern's chance, labelers' reliability.

    Votes are taken as independent given the truth; every kind has its own share of personal spans.
    """
    chance = []
    for _, votes, _ in patterns:
        said = [v for v in votes if v >= 0]
        chance.append((0.5 + sum(said)) / (1 + len(said)))
    table: list[dict] = []
    for _ in range(rounds):
        table = []
        for labeler in range(len(LABELERS)):
            seen = {(y, v): 1.0 for y in (0, 1) for v in (-1, 0, 1)}
            seen[1, 1] += 1  # a labeler is more likely right than wrong
            seen[0, 0] += 1
            for (_, votes, n), p in zip(patterns, chance):
                seen[1, votes[labeler]] += n * p
                seen[0, votes[labeler]] += n * (1 - p)
            total = {y: sum(seen[y, v] for v in (-1, 0, 1)) for y in (0, 1)}
            table.append({k: c / total[k[0]] for k, c in seen.items()})
        share = {}
        for kind in {k for k, _, _ in patterns}:
            own = [(n, p) for (k, _, n), p in zip(patterns, chance) if k == kind]
            share[kind] = (1 + sum(n * p for n, p in own)) / (2 + sum(n for n, _ in own))
        new = []
        for kind, votes, _ in patterns:
            odds = math.log(share[kind] / (1 - share[kind]))
            odds += sum(math.log(t[1, v] / t[0, v]) for t, v in zip(table, votes))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        chance = new
    names = [{"for_personal": t[1, 1], "against_personal": t[1, 0], "for_other": t[0, 1], "against_other": t[0, 0]} for t in table]
    return chance, names


def train(patterns: list[tuple[str, tuple, int]], steps: int = 400, rate: float = 1.0) -> Classifier:
    """The classifier that EM's answers teach; patterns weigh by the logarithm of their counts."""
    chance, reliability = estimate(patterns)
    kinds = dict.fromkeys(KINDS, 0.0)
    votes = [[0.0, 0.0, 0.0] for _ in LABELERS]
    weights = [1 + math.log(n) for _, _, n in patterns]
    total = sum(weights) or 1.0
    for _ in range(steps):
        slope_kinds = dict.fromkeys(KINDS, 0.0)
        slope_votes = [[0.0, 0.0, 0.0] for _ in LABELERS]
        for (kind, said, _), p, w in zip(patterns, chance, weights):
            z = kinds[kind] + sum(votes[i][v + 1] for i, v in enumerate(said))
            miss = w * (1 / (1 + math.exp(-z)) - p) / total
            slope_kinds[kind] += miss
            for i, v in enumerate(said):
                slope_votes[i][v + 1] += miss
        for kind in KINDS:
            kinds[kind] -= rate * (slope_kinds[kind] + 1e-3 * kinds[kind])
        for i in range(len(LABELERS)):
            for v in range(3):
                votes[i][v] -= rate * (slope_votes[i][v] + 1e-3 * votes[i][v])
    return Classifier(kinds, votes, reliability)


def fit(candidates: DataFrame) -> Classifier:
    """A classifier from a column ``spans`` of candidates; only counts per pattern of votes are fetched.

    There are at most ``len(KINDS) * 3 ** len(LABELERS)`` patterns, whatever the number of rows.
    """
    counted = candidates.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count()
    return train(sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in counted.collect()))


def decided(spans: Column, model: Classifier) -> Column:
    """The spans that stay: valid base spans, and what the classifier takes of the added kinds."""
    kinds = F.create_map(*(F.lit(x) for kind in KINDS for x in (kind, model.kinds[kind])))

    def score(s: Column) -> Column:
        z = F.element_at(kinds, s["kind"])
        for i, weights in enumerate(model.votes):
            z = z + F.element_at(F.array(*map(F.lit, weights)), s["votes"][i] + 2)
        return z

    return F.filter(spans, lambda s: F.when(s["kind"].isin(BASE), s["votes"][0] == 1).otherwise((s["votes"][0] == 1) & (score(s) > 0)))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Classifier]:
    """``(found, model)``: ``id, spans`` for every row of ``docs``, and the classifier that chose.

    ``spans`` is sorted: ``start, place, end, kind, votes`` in code points, end exclusive.

    * Null text counts as empty; empty texts have no spans. Null ids and repeated rows keep a row each.
    * Texts of any length are searched whole. Equal starts sort by the order of the kinds.
    * Without any candidate, or in an empty table, nothing is found; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    candidates = stored(with_candidates(rows, "text", "spans").select("id", "spans"), "candidates")
    model = fit(candidates)
    return candidates.select("id", decided(F.col("spans"), model).alias("spans")), model


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, their digest and all spans, one row per row of ``found``."""
    count = lambda kind: F.size(of_kinds(F.col("spans"), [kind])).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias(id_col), *map(count, BASE), digest(F.col("spans"), BASE).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def _without(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; what overlaps goes with the first."""
    kind = "array<struct<start:long,end:long,done:long,kind:string>>"

    def add(state: Column, s: Column) -> Column:
        piece = F.struct(s["start"].alias("start"), s["end"].alias("end"), state["done"].alias("done"), s["kind"].alias("kind"))
        return F.struct(F.greatest(state["done"], s["end"]).alias("done"), F.concat(state["pieces"], F.array(piece)).alias("pieces"))

    begin = F.struct(F.lit(0).cast("long").alias("done"), F.array().cast(kind).alias("pieces"))
    walked = F.aggregate(spans, begin, add)

    def written(p: Column) -> Column:
        before = F.substr(text, (p["done"] + 1).cast("int"), F.greatest(p["start"] - p["done"], F.lit(0)).cast("int"))
        return F.when(p["start"] >= p["done"], F.concat(before, F.lit("<"), p["kind"], F.lit(">"))).otherwise(F.lit(""))

    pieces = F.array_join(F.transform(walked["pieces"], written), "")
    return F.concat(pieces, F.substr(text, (walked["done"] + 1).cast("int")))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with personal data in the text masked; other columns and null texts as they are.

    The first pass counts votes, the second finds the spans again and writes the texts; nothing but the
    counts is shuffled.
    """
    _, model = find_personal_data(docs, id_col, text_col)
    packed = docs.select(F.col(text_col).alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    packed = with_candidates(packed, "text", "spans").withColumn("spans", decided(F.col("spans"), model))
    clean = F.when(F.size("spans") > 0, _without(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return packed.withColumn("text", clean).select(
        *(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns)
    )
