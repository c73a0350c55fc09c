"""Repair of conversations against enumerated edits, on rows with nulls, ties, repeats and conversations that are cut into stretches."""
from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from shapeindex.llm import turns

CONV = "conv_id long, turn long, role string, text string, part string, whole boolean"
WHITE = " \t\n\x0b\x0c\r"


def classify(rows):
    """(role, text, fault) in order; rows are (turn, role, text)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, out = set(), []
    for _, role, text in order:
        body = text.rstrip(WHITE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def with_inserts(rows):
    """(cost, audit, repaired) over all edits and all ways to insert up to three rows."""
    best = None
    for n in range(4):
        for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
            for names in itertools.product(("user", "assistant"), repeat=n):
                mixed, k = [], 0
                for i in range(len(rows) + 1):
                    while k < n and places[k] == i:
                        mixed.append((names[k], None, "insert"))
                        k += 1
                    if i < len(rows):
                        mixed.append(rows[i])
                found = fixed(mixed)
                if found and (best is None or found[:2] < best[:2]):
                    best = found
    return best


def fixed(rows):
    best = None
    choices = [["I"] if f == "insert" else ["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, _, f in rows]
    for edits in itertools.product(*choices):
        roles, cost, out = "", 0, []
        for e, (role, text, fault) in zip(edits, rows, strict=True):
            if e == "D":
                cost += 2
                continue
            new = role if e in "IK" else "user" if e == "Ru" else "assistant"
            cost += {"I": 5, "K": 0}.get(e, 1) + (5 if fault == "truncated" else 0)
            roles += new[:1] or "-"
            out.append(f"{new}:{text or ''}")
        if re.fullmatch(r"(s?(ua)+)?", roles):
            found = (cost, "".join(e[0] for e in edits), out)
            best = min(best, found) if best else found
    return best


@pytest.mark.parametrize("seed", range(60))
def test_edits_equal_enumeration(seed):
    rng = random.Random(seed)
    rows = classify([(i, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", "", "c!", f"d{i}.", f"e{i}"])) for i in range(rng.randint(0, 4))])
    cost, audit, out = with_inserts(rows)
    state = turns.Stretch()
    for i, (role, text, fault) in enumerate(rows):
        state.add(i, role, 1, fault, text)
    runs = tuple((s, n) for s, n in state.runs)
    assert turns.whole(runs) == (cost, audit)
    assert [f"{r}:{t}" for r, t in turns.apply_edits(audit, runs, 0, state.roles, state.texts)] == out


def simple(rows):
    """Cost and audit row by row, without runs."""
    costs = [turns.END]
    symbols = ["x" if f in ("blank", "duplicate") else (r[:1] if r[:1] in ("s", "u", "a") else "o").upper() if f else (r[:1] if r[:1] in ("s", "u", "a") else "o") for r, _, f in rows]
    for s in reversed(symbols):
        costs.append(turns.back(turns.step(s), costs[-1]))
    audit, q = [], 0
    for k, s in enumerate(symbols):
        q = turns.unroll_run(s, 1, q, costs[len(symbols) - k - 1], audit)
    while q not in (0, 3):
        audit.append("I")
        q = turns.FILL[q]
    return costs[-1][0], "".join(audit)


@pytest.mark.parametrize("seed", range(20))
def test_long_runs(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(rng.randint(1, 8)):
        one = (rng.choice(["system", "user", "assistant", "tool"]), "x", rng.choice(["", "", "truncated", "blank"]))
        rows += [one] * rng.choice([1, 2, 7, 64, 100])
    state = turns.Stretch()
    for i, (role, text, fault) in enumerate(rows):
        state.add(i, role, 1, fault, text)
    runs = tuple((s, n) for s, n in state.runs)
    assert turns.whole(runs) == simple(rows)
    m = turns.IDENTITY
    for s, n in runs:
        m = turns.product(m, turns.run_matrix(s, n))
    assert turns.back(m, turns.END)[0] == simple(rows)[0]


def table(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(12), None, 50, 51]:
        n = 200 if c == 3 else rng.randint(1, 9)
        for i in range(n):
            turn = rng.choice([None, i, i, i, i // 2])
            rows.append((c, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""]),
                         rng.choice([None, "", " \n", "a.", "b? ", f"t{i}.", f"t{i}", "x" * 3000 + "."]), "p", True))
    return rows + [(52, 1, "user", "same.", "p", None)] * 40 + [(53, None, None, None, None, None)]


def expected(rows, damaged=True):
    live, convs = defaultdict(list), {r[0] for r in rows}
    for c, t, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damaged else 9
        if k == 0:
            continue
        text = "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text
        live[c] += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for c in convs:
        rows_ = classify(live[c])
        known = [t for t, _, _ in live[c] if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        faults = [f for _, _, f in rows_]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows_))
        cost, audit = simple(rows_)
        state = turns.Stretch()
        for i, (role, text, fault) in enumerate(rows_):
            state.add(i, role, 1, fault, text)
        lines = "\n".join(f"{r}:{t}" for r, t in turns.apply_edits(audit, state.runs, 0, state.roles, state.texts))
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


@pytest.mark.parametrize("stretch_rows,stretch_bytes", [(3, 1 << 20), (65_536, 4 << 20), (65_536, 5_000)])
def test_conversations(spark, stretch_rows, stretch_bytes):
    rows = table(5)
    df = spark.createDataFrame(rows, CONV).repartition(3)
    got = turns.conversations(turns.repair(turns.damage(df), stretch_rows, stretch_bytes)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows) and len(got) == len({r[0] for r in rows})
    undamaged = turns.conversations(turns.repair(df, stretch_rows, stretch_bytes)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in undamaged} == expected(rows, damaged=False)


def test_one_long_conversation_is_many_stretches(spark):
    """A conversation with nearly all rows is cut over partitions, and its digest is that of the whole."""
    rows = [(7, i, "user" if i % 3 else "assistant", f"w{i}.", "p", True) for i in range(5000)] + [(8, 0, "user", "q?", "p", True), (8, 1, "assistant", "a.", "p", True)]
    parts = turns.repair(spark.createDataFrame(rows, CONV), 100).where("conv_id = 7")
    assert parts.count() > 40
    got = {r.conv_id: tuple(r)[1:] for r in turns.conversations(turns.repair(spark.createDataFrame(rows, CONV), 100)).collect()}
    assert got == expected(rows, damaged=False)


def test_no_rows(spark):
    df = spark.createDataFrame([], CONV)
    assert turns.conversations(turns.repair(turns.damage(df))).count() == 0
