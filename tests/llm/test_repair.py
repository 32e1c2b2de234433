"""Conversation repair against a plain whole-conversation dynamic programme."""

import hashlib
import random
import re
import zlib

import pytest

from trendlab.llm import repair

CONV = "conv_id long, turn long, role string, text string, pos int, chunk string, cls int, vin string"
SPACE = "\x20\x09-\x0D"


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        role = "user" if d == 4 else role
        out += [(conv, turn, role, text)] * (2 if d == 3 else 1)
    return out


KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
NAME = {"u": "user", "a": "assistant"}


def brute(rows):
    """(cost, audit, lines) by a suffix programme over (row, state) on whole strings."""
    n, classes, seen = len(rows), [], set()
    for _, _, role, text in rows:
        if not re.search(f"[^{SPACE}]", text):
            classes.append("blank")
        elif (role, text) in seen:
            classes.append("dup")
        else:
            last = re.findall(f"[^{SPACE}]", text)[-1]
            classes.append("ok" if last in ".!?" else "trunc")
        seen.add((role, text))
    best = [[None] * 4 for _ in range(n + 1)]
    best[n] = [(0, "", ()), (4, "II", ("user:", "assistant:")), (2, "I", ("assistant:",)), (0, "", ())]
    for i in range(n - 1, -1, -1):
        role, text = rows[i][2], rows[i][3]
        extra = 1 if classes[i] == "trunc" else 0
        for s in range(4):
            c, a, l = best[i + 1][s]
            opts = [(3 + c, "D" + a, l)]
            if classes[i] in ("ok", "trunc"):
                if (s, role[:1]) in KEEP:
                    c, a, l = best[i + 1][KEEP[s, role[:1]]]
                    opts.append((extra + c, "K" + a, (f"{role}:{text}",) + l))
                r, t = NEXT[s]
                c, a, l = best[i + 1][t]
                opts.append((2 + extra + c, "R" + a, (f"{role if role[:1] == r else NAME[r]}:{text}",) + l))
            best[i][s] = min(opts, key=lambda o: (o[0], o[1]))
        for _ in range(3):
            for s in range(4):
                r, t = NEXT[s]
                c, a, l = best[i][t]
                best[i][s] = min(best[i][s], (2 + c, "I" + a, (f"{NAME[r]}:",) + l), key=lambda o: (o[0], o[1]))
    if n == 0:
        return classes, (0, "", ())
    s0 = best[0][0]
    return classes, s0


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], [])
    for r in damage(rows):
        by[r[0]].append(r)
    out = {}
    for conv, rs in by.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        classes, (cost, audit, lines) = brute(rs)
        turns = [r[1] for r in rs if r[1] is not None]
        ini = [r[2][:1] for r in rs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, classes.count("blank"), classes.count("dup"), classes.count("trunc"), illegal, cost, audit, sha)
    return out


@pytest.fixture
def conversations():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", None, "User", ""]
    texts = ["Hello.", "hi", "", "   ", None, "Why?", "Sure! ", "x" * 30_000 + ".", "ok.\n", "no end"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(0, 14)):
            rows.append((conv, rng.choice([turn, turn, None, turn + 3]), rng.choice(roles), rng.choice(texts)))
    rows += [rows[5], rows[5], (None, 1, "user", "Hi."), (None, None, None, None), (999, None, "user", "Hi.")]
    return [(*r, 1, "c", 2, "v") for r in rows]


@pytest.mark.parametrize("chunk_rows", [3, 20_000])
def test_repair_against_brute_force(spark, conversations, chunk_rows):
    df = spark.createDataFrame(conversations, CONV).repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(df, chunk_rows=chunk_rows).collect()}
    assert got == expected(conversations)


def test_repair_empty(spark):
    assert repair.repair(spark.createDataFrame([], CONV)).count() == 0
