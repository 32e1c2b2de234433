"""Conversation structure repair: the cheapest edits that give a legal sequence of roles.

A repaired conversation has role initials ``(s?(ua)+)?``. Each row is kept (0), given the role the
grammar expects next (2) or deleted (3; required for blank and duplicate rows); empty user or
assistant rows may be inserted anywhere (2); a truncated row that stays adds 1. Among the cheapest
edit scripts the one whose initials (``D I K R``) are least in ASCII is taken.

Method: rank-convergence parallel Viterbi. Rows are ordered globally and cut into chunks of at
most ``chunk_rows`` (a chunk is a conversation's rows inside one range partition, so a conversation
of any size is spread over many tasks). The backward costs-to-go of every chunk are computed in
parallel, each chunk starting from a speculative vector except a conversation's last one, which
starts from the true end costs. Fix-up passes rerun only the chunks whose incoming vector (the
start costs of the chunk after it) is not parallel to what they started from, i.e. differs by more
than one constant; they stop when all are parallel. The stitched costs then drive a greedy trace
from each of the four grammar states per chunk; the start state of every chunk follows by pointer
doubling over the chunk table; a last pass writes the repaired rows of the chosen trace.

Grammar states: 0 nothing yet, 1 after ``s``, 2 after ``u``, 3 after ``a``; 0 and 3 accept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import small, stored

#: Rows of one chunk at most (a range partition holds about that many).
CHUNK_ROWS = 20_000
#: Fixed values of the contract: damage by crc32(conv_id:turn) % 20, edit costs.
DAMAGE_MOD = 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

_OK, _BLANK, _DUP, _TRUNC = 0, 1, 2, 3
# Role initial kept from a state -> next state; the insert or rerole from a state: (initial, next).
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
_ROLE = {"u": "user", "a": "assistant"}
_END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)  # inserts that finish from each state


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: ``conv_id, turn, role, text`` (role and text never null).

    Null role and text become one space, as does a null conv_id or turn inside the key
    ``conv_id:turn`` whose crc32 % 20 picks the damage: 0 drops the row, 1 empties its text, 2
    removes its ``.!?``, 3 repeats it (same turn), 4 sets role ``user``.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    d = F.crc32(key.cast("binary")) % DAMAGE_MOD
    text = F.coalesce(F.col("text"), space)
    return (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             F.coalesce(F.col("role").cast("string"), space).alias("role"),
                             text.cast("string").alias("text"), d.alias("d"))
        .filter(F.col("d") != 0)
        .select("conv_id", "turn",
                F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                F.when(F.col("d") == 1, F.lit("")).when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", ""))
                .otherwise(F.col("text")).alias("text"),
                F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
        .drop("copy")
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pos`` (partition in the upper bits, then place) and ``chunk`` (pos of the first row of the
    conversation's run in this partition) of rows that arrive in their global order."""
    from pyspark import TaskContext

    base, i, now, chunk = TaskContext.get().partitionId() << 33, 0, object(), 0
    for batch in batches:
        conv = batch.column("conv_id").to_pylist()
        chunks = []
        for k, c in enumerate(conv):
            if c != now or k + i == 0:
                now, chunk = c, base + i + k
            chunks.append(chunk)
        pos = pa.array(np.arange(base + i, base + i + len(conv), dtype=np.int64))
        yield batch.append_column("pos", pos).append_column("chunk", pa.array(chunks, pa.int64()))
        i += len(conv)


def _classified(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Rows in global order with ``pos``, ``chunk`` and their first fault ``cls``.

    The order is conv_id, turn (nulls first), role, text; equal rows are interchangeable and a random
    salt lets the range partitioning split them, so no chunk grows beyond about ``chunk_rows``.
    """
    n = rows.count()
    parts = max(1, math.ceil(n / chunk_rows))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    schema = T.StructType([*rows.schema.fields, T.StructField("salt", T.DoubleType()),
                           T.StructField("pos", T.LongType()), T.StructField("chunk", T.LongType())])
    ordered = stored(
        rows.withColumn("salt", F.rand(17)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .mapInArrow(_numbered, schema).drop("salt"),
        "conversation-rows",
    )
    firsts = ordered.groupBy("conv_id", "role", "text").agg(F.min("pos").alias("first")).select(
        F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("text").alias("f_text"), "first")
    seen = ordered.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_conv"))
                        & (F.col("role") == F.col("f_role")) & (F.col("text") == F.col("f_text")))
    text = F.col("text")
    blank = ~text.rlike("[^\\x20\\x09-\\x0D]")
    last = F.regexp_extract(text, "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$", 1)
    cls = (F.when(blank, _BLANK).when(F.col("pos") > F.col("first"), _DUP)
           .when(~last.isin(".", "!", "?"), _TRUNC).otherwise(_OK))
    return stored(seen.select("conv_id", "turn", "role", "text", "pos", "chunk", cls.alias("cls")),
                  "conversation-classes")


# ------------------------------------------------------------------ per chunk, in Python workers

def _step(cls: int, initial: str, after: list[int]) -> list[int]:
    """Costs-to-go before one row's inserts, from the costs after it."""
    extra = TRUNCATED if cls == _TRUNC else 0
    here = []
    for s in range(4):
        best = DELETE + after[s]
        if cls == _OK or cls == _TRUNC:
            to = _KEEP.get((s, initial))
            if to is not None:
                best = min(best, KEEP + extra + after[to])
            best = min(best, REROLE + extra + after[_NEXT[s][1]])
        here.append(best)
    return _inserted(here)


def _inserted(here: list[int]) -> list[int]:
    """Inserts at one gap: a state may go on to the next by an insert (cycles cost more than 0)."""
    for _ in range(3):
        for s in range(4):
            here[s] = min(here[s], INSERT + here[_NEXT[s][1]])
    return here


def _backward(cls: list[int], initials: list[str], vin: list[int], last: bool) -> list[list[int]]:
    """Costs-to-go at every gap of a chunk, from the gap after its last row backwards."""
    h = [None] * (len(cls) + 1)
    h[-1] = _END.tolist() if last else list(vin)
    for i in range(len(cls) - 1, -1, -1):
        h[i] = _step(cls[i], initials[i], h[i + 1])
    return h


def _trace(cls, initials, h, state: int, last: bool) -> tuple[int, int, str, list[tuple[int, str, int]]]:
    """Least edit script of a chunk from ``state``: end state, cost, initials, kept rows.

    Kept rows are ``(row or -1 for an insert, initial, state after)``.
    """
    audit, rows, cost, i, n = [], [], 0, 0, len(cls)
    while True:
        if i == n and (not last or h[i][state] == 0 and state in (0, 3)):
            return state, cost, "".join(audit), rows
        options = []  # in ASCII order of their initials
        if i < n:
            options.append(("D", DELETE, i + 1, state, None))
        nxt_initial, nxt = _NEXT[state]
        options.append(("I", INSERT, i, nxt, nxt_initial))
        if i < n and cls[i] in (_OK, _TRUNC):
            extra = TRUNCATED if cls[i] == _TRUNC else 0
            if (state, initials[i]) in _KEEP:
                options.append(("K", KEEP + extra, i + 1, _KEEP[state, initials[i]], initials[i]))
            options.append(("R", REROLE + extra, i + 1, nxt, nxt_initial))
        for name, price, j, to, initial in options:
            if price + h[j][to] == h[i][state]:
                audit.append(name)
                cost += price
                if name != "D":
                    rows.append((-1 if name == "I" else i, initial, to))
                i, state = j, to
                break
        else:  # pragma: no cover - the costs are consistent by construction
            raise AssertionError("no optimal edit")


def _per_chunk(fn, columns: list[str]):
    """A function over a block of many chunks (rows in any order) that calls ``fn`` once per chunk
    with its rows as lists in ``pos`` order; one output row per chunk."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk", "pos"], kind="stable")
        chunk = pdf["chunk"].to_numpy()
        cuts = (np.flatnonzero(np.diff(chunk)) + 1).tolist()
        cols = {c: pdf[c].tolist() for c in pdf.columns}
        cols["initial"] = [r[:1] for r in cols["role"]]
        out = [fn({c: v[a:b] for c, v in cols.items()}) for a, b in zip([0, *cuts], [*cuts, len(chunk)])]
        return pd.DataFrame(out, columns=columns)
    return run


def _backward_pass(c: dict) -> dict:
    h = _backward(c["cls"], c["initial"], [int(v) for v in c["vin"][0]], bool(c["last"][0]))
    return {"chunk": c["chunk"][0], "vout": h[0]}


def _trace_pass(c: dict) -> dict:
    last = bool(c["last"][0])
    h = _backward(c["cls"], c["initial"], [int(v) for v in c["vin"][0]], last)
    ends, costs = [], []
    for s in range(4):
        end, cost, _, _ = _trace(c["cls"], c["initial"], h, s, last)
        ends.append(end)
        costs.append(cost)
    return {"chunk": c["chunk"][0], "ends": ends, "costs": costs}


def _lines_pass(c: dict) -> dict:
    last, initials = bool(c["last"][0]), c["initial"]
    h = _backward(c["cls"], initials, [int(v) for v in c["vin"][0]], last)
    _, cost, audit, kept = _trace(c["cls"], initials, h, int(c["state"][0]), last)
    roles, texts = c["role"], c["text"]
    lines = []
    for row, initial, _ in kept:
        if row < 0:
            lines.append(f"{_ROLE[initial]}:")
        else:
            role = roles[row] if initials[row] == initial else _ROLE[initial]
            lines.append(f"{role}:{texts[row]}")
    illegal = sum(1 for a, b in zip(initials, initials[1:]) if a + b not in ("su", "ua", "au"))
    return {"chunk": c["chunk"][0], "audit": audit, "cost": cost, "lines": lines,
            "first": initials[0] if initials else "", "final": initials[-1] if initials else "", "illegal": illegal}


_VOUT = "chunk long, vout array<long>"
_ENDS = "chunk long, ends array<int>, costs array<long>"
_LINES = "chunk long, audit string, cost long, lines array<string>, first string, final string, illegal long"


def _parallel(a, b) -> bool:
    d = {x - y for x, y in zip(a, b)}
    return len(d) == 1


def repair(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per original conv_id (nulls one group): counts of faults and the cheapest repair.

    Columns: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost`` (long), ``audit``,
    ``repaired_sha256`` (of the repaired ``role:text`` rows joined by newlines). Rows of a
    conversation are taken by turn, nulls first, then role and text; the first fault of a row counts
    (blank: no character outside ``\\x20\\x09-\\x0D``; duplicate: role and text seen earlier;
    truncated: last such character not ``.!?``). ``illegal`` counts adjacent role initials not
    ``su``, ``ua`` or ``au``; ``gaps`` is max - min + 1 - distinct turns, nulls ignored (0 without
    turns). A conversation left without rows: zeros, empty audit, the hash of the empty string.
    Role initials are the first character of the role as it is, so ``User`` or a null role (one
    space) is never kept. Extra columns of the input are ignored. Empty input: empty result.
    """
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = _classified(damaged(conversations), chunk_rows)

    # The chunk table: one row per chunk, with its neighbours in the conversation. A conversation
    # has rows / chunk_rows chunks, so the window holds few rows even for a huge conversation.
    order = Window.partitionBy("conv_id").orderBy("chunk")
    chunks = stored(
        rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
        .select("conv_id", "chunk", F.lead("chunk").over(order).alias("next"), F.lag("chunk").over(order).alias("prev"))
        .withColumn("last", F.col("next").isNull()),
        "conversation-chunks",
    )
    slim = rows.select("chunk", "pos", "cls", "role")

    def run(vin: DataFrame, fn, schema: str, of: DataFrame = slim) -> DataFrame:
        vin = stored(vin, "conversation-in")
        names = [f.split()[0] for f in schema.split(", ")]
        return stored(of.join(small(vin, 96), "chunk").groupBy(F.shiftright("chunk", 33).alias("block"))
                      .applyInPandas(_per_chunk(fn, names), schema), "conversation-pass")

    def shift(d: Column) -> Column:
        return F.zip_with(d, F.col("vin"), lambda a, b: a - b)

    # Backward costs: speculative (zeros) except in the last chunk of each conversation.
    state = chunks.select("chunk", "last", F.array(*[F.lit(0).cast("long")] * 4).alias("vin"))
    state = stored(state.join(run(state, _backward_pass, _VOUT), "chunk"), "conversation-vectors")
    while True:  # fix-ups: rerun the chunks whose incoming vector is not parallel to their start
        want = state.select(F.col("chunk").alias("next"), F.col("vout").alias("want"))
        check = state.join(chunks.select("chunk", "next"), "chunk").join(want, "next", "left")
        d = shift(F.col("want"))
        redo = stored(check.filter(F.col("want").isNotNull() & (F.array_min(d) != F.array_max(d)))
                      .select("chunk", "last", F.col("want").alias("vin")), "conversation-redo")
        if redo.count() == 0:
            break
        again = run(redo, _backward_pass, _VOUT).join(redo, "chunk").select(
            "chunk", F.col("vin").alias("vin2"), F.col("vout").alias("vout2"))
        state = stored(
            state.join(again, "chunk", "left").select(
                "chunk", "last", F.coalesce("vin2", "vin").alias("vin"), F.coalesce("vout2", "vout").alias("vout")),
            "conversation-vectors",
        )
    # Stitched: each chunk starts from the start costs of the chunk after it.
    want = state.select(F.col("chunk").alias("next"), F.col("vout").alias("want"))
    vin = stored(state.join(chunks.select("chunk", "next", "prev"), "chunk").join(want, "next", "left")
                 .select("chunk", "last", "prev", F.coalesce("want", "vin").alias("vin")), "conversation-vin")
    maps = run(vin.select("chunk", "last", "vin"), _trace_pass, _ENDS)

    # Start state of every chunk by pointer doubling: g maps the state at the start of `link` to the
    # state at the start of this chunk; without a link g is constant and the state is known.
    table = stored(
        vin.select("chunk", F.col("prev").alias("link"))
        .join(maps.select(F.col("chunk").alias("link"), F.col("ends").alias("g")), "link", "left")
        .select("chunk", "link", F.coalesce("g", F.array(*[F.lit(0)] * 4)).alias("g")),
        "conversation-maps",
    )
    # The map of the first hop leads from the previous chunk's start: compose with its own link.
    while table.filter(F.col("link").isNotNull()).count():
        hop = table.select(F.col("chunk").alias("link"), F.col("link").alias("up"), F.col("g").alias("h"))
        table = stored(
            table.join(hop, "link", "left").select(
                "chunk", F.col("up").alias("link"),
                F.when(F.col("h").isNull(), F.col("g"))
                .otherwise(F.transform("h", lambda x: F.element_at(F.col("g"), x + 1))).alias("g")),
            "conversation-maps",
        )
    start = table.select("chunk", F.element_at("g", 1).alias("state"))
    lines = run(vin.join(start, "chunk").select("chunk", "last", "vin", "state"), _lines_pass, _LINES,
                rows.select("chunk", "pos", "cls", "role", "text"))

    per_chunk = lines.join(chunks.select("chunk", "conv_id", "next"), "chunk")
    firsts = per_chunk.select(F.col("chunk").alias("next"), F.col("first").alias("next_first"))
    per_chunk = per_chunk.join(firsts, "next", "left")
    across = F.when(F.col("next_first").isNotNull()
                    & ~F.concat("final", "next_first").isin("su", "ua", "au"), 1).otherwise(0)
    summary = per_chunk.groupBy("conv_id").agg(
        F.sum("cost").alias("cost"), F.sum(F.col("illegal") + across).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "")
        .alias("audit"),
    )
    hashes = per_chunk.select("conv_id", "chunk", "lines").repartition("conv_id").sortWithinPartitions(
        "conv_id", "chunk").mapInArrow(_hash_runs, "conv_id long, repaired_sha256 string")
    turns = rows.groupBy("conv_id").agg(
        F.sum((F.col("cls") == _BLANK).cast("long")).alias("blank"),
        F.sum((F.col("cls") == _DUP).cast("long")).alias("duplicate"),
        F.sum((F.col("cls") == _TRUNC).cast("long")).alias("truncated"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
    )
    out = ids
    for part in (turns, summary, hashes):
        part = part.withColumnRenamed("conv_id", "other")
        out = out.join(part, out["conv_id"].eqNullSafe(part["other"]), "left").drop("other")
    zero, empty = F.lit(0).cast("long"), hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", *[F.coalesce(F.col(c).cast("long"), zero).alias(c)
                     for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per conversation, fed chunk by chunk in order: never a whole group in memory."""
    now, digest, any_line, out = object(), None, False, []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()),
                                           pa.array([o[1] for o in out], pa.string())],
                                          names=["conv_id", "repaired_sha256"])
    for batch in batches:
        for conv, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
            if digest is None or conv != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest, any_line = conv, hashlib.sha256(), False
            for line in lines:
                digest.update((("\n" if any_line else "") + line).encode("utf-8"))
                any_line = True
        if len(out) > 1024:
            yield flush()
            out = []
    if digest is not None:
        out.append((now, digest.hexdigest()))
    if out:
        yield flush()
