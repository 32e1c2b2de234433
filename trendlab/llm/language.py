"""Language identification by a byte convolutional network, written and trained in numpy.

Bytes are embedded, filters of several widths slide over them, the largest response of each filter in
a window is kept, and a softmax over those names the language. A text is cut into fixed-length windows
from end to end; its answer is the mean over its windows, weighted by the bytes they hold.

Training sees a bounded sample of labelled rows. Prediction runs in batches of windows: the
embedding and the filters fold into tables over byte pairs, so that a filter's response is a sum of
two looked-up rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of a window; filter widths; filters of each width; numbers per embedded byte.
WINDOW, WIDTHS, FILTERS, EMBEDDED = 256, (2, 3, 4), 16, 8
#: Labelled documents a language is learned from at most, in expectation, and windows of each.
SAMPLE, SAMPLE_WINDOWS = 400, 4
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Windows worked on at once; bounds the memory of a task.
_BLOCK = 256


class Model(NamedTuple):
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDED; byte 0 pads and is zero
    filters: list[np.ndarray]  # per width: width * EMBEDDED x FILTERS
    weights: np.ndarray  # all filters x languages
    bias: np.ndarray


def held_out(id_col: str) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> list:
    """``(lang, window)`` pairs of about ``sample`` documents per language, chosen by a hash of the id."""
    usable = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).filter("id is not null and lang is not null and text is not null").filter(~held_out("id"))
    # One row per language.
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return []
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample / n))))
    chosen = usable.filter(
        F.shiftrightunsigned(F.xxhash64("id", F.lit(11)), 11) / F.lit(float(1 << 53)) < F.element_at(share, F.col("lang"))
    )
    spare = F.greatest(F.length("text") - WINDOW, F.lit(0))
    parts = F.array(*(
        F.substring(F.col("text"), (F.floor(spare * i / max(SAMPLE_WINDOWS - 1, 1)) + 1).cast("int"), F.lit(WINDOW))
        for i in range(SAMPLE_WINDOWS)
    ))
    rows = chosen.select("id", "lang", F.explode(F.array_distinct(parts)).alias("part")).filter("part != ''").collect()
    return [(r["lang"], r["part"]) for r in sorted(rows, key=lambda r: (r["id"], r["lang"], r["part"]))]


def _matrix(parts: list[bytes], length: int) -> np.ndarray:
    out = np.zeros((len(parts), length), np.uint8)
    for row, part in zip(out, parts):
        part = part[:length]
        row[: len(part)] = np.frombuffer(part, np.uint8)
    return out


def train(windows: list, steps: int = 400, batch: int = 64, rate: float = 0.004, seed: int = 3) -> Model | None:
    """Fit a model with Adam on whole windows and on pieces of them, so that short texts count too."""
    if not windows:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in windows})
    index = {lang: i for i, lang in enumerate(languages)}
    by_language: list[list[bytes]] = [[] for _ in languages]
    for lang, text in windows:
        by_language[index[lang]].append(text.encode("utf-8", "surrogatepass"))
    p = {"e": rng.normal(0, 0.3, (256, EMBEDDED)), "w": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "b": np.zeros(len(languages))}
    p |= {f"f{w}": rng.normal(0, (w * EMBEDDED) ** -0.5, (w * EMBEDDED, FILTERS)) for w in WIDTHS}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    reach = max(WIDTHS) - 1
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(languages), batch)
        parts = []
        for label in labels:
            part = by_language[label][rng.integers(len(by_language[label]))]
            if rng.random() < 0.5:
                n = int(rng.integers(8, 96))
                at = int(rng.integers(0, max(1, len(part) - n)))
                part = part[at : at + n]
            parts.append(part)
        data = _matrix(parts, WINDOW + reach)
        p["e"][0] = 0
        embedded = p["e"][data]
        pooled, where = [], []
        for w in WIDTHS:
            out = sum(embedded[:, j : j + WINDOW] @ p[f"f{w}"][j * EMBEDDED : (j + 1) * EMBEDDED] for j in range(w))
            at = out.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(out, at[:, None], axis=1)[:, 0])
        hidden = np.concatenate(pooled, axis=1)
        logits = hidden @ p["w"] + p["b"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(batch), labels] -= 1
        prob /= batch
        grad = {"w": hidden.T @ prob, "b": prob.sum(axis=0), "e": np.zeros_like(p["e"])}
        back = prob @ p["w"].T
        for k, (w, at) in enumerate(zip(WIDTHS, where)):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            spots = at[:, :, None] + np.arange(w)  # batch x filter x width: only the winners learn
            patch = embedded[np.arange(batch)[:, None, None], spots].reshape(batch, FILTERS, w * EMBEDDED)
            grad[f"f{w}"] = np.einsum("bf,bfe->ef", d, patch)
            inner = d[:, :, None] * p[f"f{w}"].T[None]
            np.add.at(grad["e"], data[np.arange(batch)[:, None, None], spots], inner.reshape(batch, FILTERS, w, EMBEDDED))
        for k, g in grad.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    p["e"][0] = 0
    return Model(languages, p["e"], [p[f"f{w}"] for w in WIDTHS], p["w"], p["b"])


class Predictor:
    """A model folded into tables over byte pairs."""

    def __init__(self, model: Model):
        self.model = model
        taps = [[model.embedding @ f[j * EMBEDDED : (j + 1) * EMBEDDED] for j in range(w)] for w, f in zip(WIDTHS, model.filters)]

        def pair(a: int, b: int, kept: list) -> np.ndarray:
            nothing = np.zeros((256, FILTERS))
            columns = [
                (t[a] if len(t) > a else nothing)[:, None, :] + (t[b] if len(t) > b else nothing)[None, :, :] for t in kept
            ]
            return np.concatenate(columns, axis=2).reshape(65536, -1).astype(np.float32)

        self.near, self.far = pair(0, 1, taps), pair(2, 3, taps[1:])

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """``windows``: rows of WINDOW bytes and the three after them."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        out = self.near[pairs[:, :WINDOW]]
        out[:, :, FILTERS:] += self.far[pairs[:, 2 : WINDOW + 2]]
        logits = out.max(axis=1) @ self.model.weights + self.model.bias
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        return prob / prob.sum(axis=1, keepdims=True)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Per text the mean of its windows; texts must not be empty."""
        counts = np.array([-(-len(t) // WINDOW) for t in texts])
        padded = b"".join(t + bytes(n * WINDOW - len(t)) for t, n in zip(texts, counts.tolist())) + bytes(3)
        flat = np.frombuffer(padded, np.uint8)
        starts = np.concatenate(([0], np.cumsum(counts)))
        total = np.zeros((len(texts), len(self.model.languages)))
        weight = np.full(starts[-1], WINDOW, np.float64)
        weight[starts[1:] - 1] = [len(t) - (n - 1) * WINDOW for t, n in zip(texts, counts.tolist())]
        owner = np.repeat(np.arange(len(texts)), counts)
        last = np.zeros(starts[-1], bool)
        last[starts[1:] - 1] = True
        for at in range(0, starts[-1], _BLOCK):
            n = min(_BLOCK, starts[-1] - at)
            block = np.lib.stride_tricks.as_strided(flat[at * WINDOW :], (n, WINDOW + 3), (WINDOW, 1)).copy()
            block[last[at : at + n], WINDOW:] = 0  # a text ends here: what follows is another text
            np.add.at(total, owner[at : at + n], self.probabilities(block) * weight[at : at + n, None])
        return total / np.maximum(np.add.reduceat(weight, starts[:-1]), 1)[:, None]


_WORKER: dict[bytes, Predictor] = {}


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = None
        if model is not None:
            key = model.weights.tobytes()
            if key not in _WORKER:
                _WORKER.clear()
                _WORKER[key] = Predictor(model)
            predictor = _WORKER[key]
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = batch.column("text").to_pylist()
                lettered = [bool(t and _LETTER.search(t)) for t in texts]
                known = [i for i, has in enumerate(lettered) if predictor and has]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    prob = predictor([texts[i].encode("utf-8", "surrogatepass") for i in known])
                    for i, row in zip(known, prob):
                        best = int(row.argmax())
                        langs[i], scores[i] = predictor.model.languages[best], float(min(row[best], 1.0))
                rest = [batch.column(c) for c in batch.schema.names if c != "text"]
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(lettered, pa.bool_()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    [*names, "lettered", "lang_pred", "score"],
                )

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model learned from a bounded sample of the labelled rows that are not held out; None without any."""
    return train(training_windows(docs, id_col, text_col, lang_col, sample))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, lang_pred, score`` for every row of ``docs``; only the text is looked at.

    * Text null or without any letter, or no model: ``und`` with score 0.
    * Ties go to the language first in code-point order. Null ids are not held out.
    * Texts of any length are read whole; repeated rows get a row each; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    guessed = rows.mapInArrow(_predict(model), f"id {kind}, lettered boolean, lang_pred string, score double")
    return guessed.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a letter; null and letterless texts go.

    A null language becomes the predicted one; labels and all other columns stay as they are. Without
    a model no language can be predicted, which is no fault of a text: the same rows stay.
    """
    row = docs.select(F.col(text_col).alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    shape = row.schema["row"].dataType.simpleString()
    guessed = row.mapInArrow(_predict(model), f"row {shape}, lettered boolean, lang_pred string, score double")
    told = F.when(F.col("lang_pred") != UNKNOWN, F.col("lang_pred"))
    fields = {c: F.col("row").getField(c) for c in docs.columns}
    fields[lang_col] = F.coalesce(fields[lang_col], told)
    return guessed.filter("lettered").select(*(f.alias(c) for c, f in fields.items()))
