"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. A blob is scanned by a rule once:
the ledger holds, for each blob, which rule versions have seen it and what they found; only unseen
pairs of blob and rule version are scanned, and the findings are joined back to every path that holds
the blob. All of it is SQL expressions; no Python runs on the executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored
from .spans import digest, joined, located, of_kinds, tagged


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    #: Holds for every text the pattern can match in; cheap.
    possible: Column | None = None
    #: Group 2 of a match must be so long.
    least_value: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _contains(*words: str) -> Column:
    low = F.lower("text")
    found = low.contains(words[0])
    for word in words[1:]:
        found = found | low.contains(word)
    return found


def rules() -> list[Rule]:
    """The base kinds as the contract fixes them, in its order, then what this scanner adds.

    The looks behind only spare the matcher starts that cannot lead to a match: a run of hex digits
    can match from its first digit or not at all.
    """
    assigned = (F.col("text").contains("=") | F.col("text").contains(":")) & _contains(
        "password", "passwd", "secret", "token", "apikey", "api_key"
    )
    return [
        Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", assigned, 6),
        Rule("access", 1, r"AKIA[A-Z0-9]{16,}", F.col("text").contains("AKIA")),
        Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}+"),
        Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", F.col("text").rlike("gh[pousr]_")),
        Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", F.col("text").contains("eyJ")),
        Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", F.col("text").contains("PRIVATE KEY-----")),
    ]


BASE = ["assign", "access", "hex"]


def _scan(blobs: DataFrame, wanted: list[Rule]) -> DataFrame:
    """``blob, rules, spans`` of ``blob, text, known``; a rule skips the blobs it knows."""
    for place, rule in enumerate(wanted):
        unseen = ~F.array_contains("known", rule.name)
        when = unseen & rule.possible if rule.possible is not None else unseen
        blobs = located(blobs, "text", rule.kind, rule.pattern, when)
        hits = F.col(rule.kind)
        if rule.least_value:
            least, pattern = rule.least_value, rule.pattern
            hits = F.filter(hits, lambda s: F.length(F.regexp_extract(s["hit"], pattern, 2)) >= least)
        blobs = blobs.withColumn(rule.kind, tagged(hits, rule.kind, place))
    names = F.array(*(F.lit(r.name) for r in wanted))
    return blobs.select(
        "blob",
        F.array_except(names, "known").alias("rules"),
        F.concat(*(F.col(r.kind) for r in wanted)).alias("spans"),
    )


def update(ledger: DataFrame | None, versions: DataFrame, wanted: list[Rule] | None = None) -> DataFrame:
    """What has to be appended to ``ledger`` so that it covers ``versions(blob, text)``."""
    wanted = wanted or rules()
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("known", F.array().cast("array<string>"))
    else:
        known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        blobs = blobs.join(known, "blob", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    names = F.array(*(F.lit(r.name) for r in wanted))
    return _scan(blobs.filter(F.size(F.array_except(names, "known")) > 0), wanted)


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ledger: DataFrame | None = None,
    wanted: list[Rule] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(findings, ledger)``: ``id, blob, spans`` for every row of ``docs``, and the grown ledger.

    ``spans`` is sorted: ``start, place, end, kind`` in code points, end exclusive, of every rule in
    its current version. Pass the returned ledger (stored) to the next call.

    * Null text counts as empty; empty texts have no spans. Null ids and repeated rows keep a row each.
    * Texts of any length are scanned whole. Equal starts sort by the rules' order, then end.
    * An empty table gives an empty result; other columns are not read.
    """
    wanted = wanted or rules()
    text = F.coalesce(F.col(text_col), F.lit(""))
    versions = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("blob"))
    new = stored(update(ledger, versions.select("blob", "text"), wanted), "ledger")
    grown = new if ledger is None else ledger.unionByName(new)
    current = [r.name for r in wanted]
    kinds = [r.kind for r in wanted]
    seen = grown.filter(F.arrays_overlap("rules", F.array(*map(F.lit, current)))).filter(F.size("spans") > 0)
    seen = seen.withColumn("spans", F.filter("spans", lambda s: F.exists("rules", lambda r: F.startswith(r, F.concat(s["kind"], F.lit("@"))) & r.isin(current))))
    seen = seen.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    spans = F.coalesce("spans", F.array().cast(seen.schema["spans"].dataType))
    found = versions.select("id", "blob").join(seen, "blob", "left").select("id", "blob", of_kinds(spans, kinds).alias("spans"))
    return found, grown


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, their digest and all spans, one row per row of ``found``."""
    count = lambda kind: F.size(of_kinds(F.col("spans"), [kind])).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias(id_col), *map(count, BASE), digest(F.col("spans"), BASE).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
