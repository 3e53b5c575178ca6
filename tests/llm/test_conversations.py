"""Conversation repair against all edits of small conversations, an automaton for long ones, and awkward tables."""
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tokenloom.llm import conversations as C

GRAMMAR = re.compile(r"(?:s?(?:ua)+)?")


def brute(rows):
    """Least (cost, audit) over all edits with at most two insertions at each place."""
    best = (10 ** 9, "")
    ops = [["D"] if must else ["D", "K", "R"] for _, must, _ in rows]
    for edits in itertools.product(*ops):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            if sum(gaps) > 3:
                continue
            cost, audit, kept = 5 * sum(gaps), "I" * gaps[0], ["?"] * gaps[0]
            for (letter, _, cut), edit, gap in zip(rows, edits, gaps[1:]):
                audit += edit + "I" * gap
                if edit == "D":
                    cost += 2
                else:
                    cost += (edit == "R") + 5 * cut
                    kept.append(letter if edit == "K" else "?")
                kept += ["?"] * gap
            if (cost, audit) >= best:
                continue
            shape = "".join(kept)  # a question mark stands for u or a
            system = shape.startswith("s")
            want = ("s" if system else "") + "ua" * ((len(shape) - system) // 2)
            if len(want) == len(shape) and GRAMMAR.fullmatch(want) and all(x in ("?", y) for x, y in zip(shape, want)):
                best = (cost, audit)
    return best


def automaton(rows):
    """The cheapest, ASCII-least way through the grammar's states from the last row back."""
    z, p, u, a = (0, ""), (10, "II"), (0, ""), (5, "I")
    add = lambda s, c, e: (s[0] + c, e + s[1])
    for letter, must, cut in reversed(rows):
        z0, p0, u0, a0 = (add(s, 2, "D") for s in (z, p, u, a))
        if not must:
            def match(want, s):
                return add(s, 5 * cut, "K") if letter == want else add(s, 5 * cut + 1, "R")
            z0, p0, u0, a0 = min(z0, match("u", a)), min(p0, match("u", a)), min(u0, match("u", a)), min(a0, match("a", u))
            if letter == "s":
                z0 = min(z0, add(p, 5 * cut, "K"))
        u, a = min(u0, add(a0, 5, "I")), min(a0, add(u0, 5, "I"))
        z, p = min(z0, add(a, 5, "I")), min(p0, add(a, 5, "I"))
    return z


def aligned(rows):
    letters = {"u": 0, "a": 1, "s": 2}
    return C.align(np.array([letters.get(x, 3) for x, _, _ in rows], dtype=np.int64), np.array([m for _, m, _ in rows], dtype=bool),
                   np.array([c for _, _, c in rows], dtype=bool))


def some_rows(rng, n):
    faults = rng.choice([0, 0.15, 0.5])
    return [(rng.choice("uasx" if rng.random() < 0.4 else "ua"), rng.random() < faults, rng.random() < faults) for _ in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_cheapest_edits(seed):
    rng = random.Random(seed)
    for n in (1, 2, 3, 4):
        rows = [(x, m, c and not m) for x, m, c in some_rows(rng, n)]
        assert aligned(rows) == brute(rows) == automaton(rows)
    for n in (5, 8, 30, 200):
        rows = [(x, m, c and not m) for x, m, c in some_rows(rng, n)]
        assert aligned(rows) == automaton(rows)


def test_long_conversation_in_blocks(monkeypatch):
    rng = random.Random(5)
    rows = [(x, m, c and not m) for x, m, c in some_rows(rng, 900)]
    want = automaton(rows)
    assert aligned(rows) == want
    monkeypatch.setattr(C, "CELLS", 100)
    assert aligned(rows) == want
    assert aligned([]) == (0, "") and aligned([("u", True, False)] * 3) == (6, "DDD")


def brute_table(rows):
    """The contract row by row in plain Python; rows as (conv_id, turn, role, text)."""
    show = lambda x: " " if x is None else str(x)
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, coded, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = automaton(coded)
        turns = [r[0] for r in own if r[0] is not None]
        lines, at = [], 0
        system, users = 0, 0
        for edit in audit:
            row = None
            if edit != "I":
                row, at = own[at], at + 1
            if edit == "D":
                continue
            if edit == "K" and row[1].startswith("s"):
                lines.append(f"{row[1]}:{row[2]}")
                system = 1
                continue
            role = ("user", "assistant")[(len(lines) - system) % 2]
            lines.append(f"{row[1] if edit == 'K' else role}:{row[2] if row else ''}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults.values(),
                     sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(coded, coded[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_of_a_table(spark):
    rng = random.Random(2)
    text = lambda: rng.choice([None, "", " \n", "Yes.", "No! ", "cut off", "Well?\t", "ü ß.", "a.b", "x " * 500 + "."])
    rows = []
    for conv in [None, *range(150)]:
        turn = rng.choice([0, 5, -3])
        for _ in range(rng.choice([1, 2, 3, 8, 30])):
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), text()))
            turn += rng.choice([0, 1, 1, 1, 3])
    rows += rows[:20]  # repeated rows
    rows += [(777, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(3000)]  # a third of all rows
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", C.F.lit("x")).withColumn("present", C.F.lit(1))
    damaged = C.damaged(frame)
    audits, fixed = C.repair(damaged, "present")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in C.digests(audits, fixed).collect()}
    assert got == brute_table(rows)
    shown = {}
    for r in fixed.collect():
        shown.setdefault(r.conv_id, []).append(r)
    for own in shown.values():
        assert [r.place for r in own] == list(range(1, len(own) + 1))
        assert GRAMMAR.fullmatch("".join(r.role[0] for r in own))


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert C.digests(*C.repair(C.damaged(empty), "present")).count() == 0
    gone = spark.createDataFrame([("a", 1, "user", "Hi."), ("b", None, None, None)], "conv_id string, turn int, role string, text string")
    got = C.digests(*C.repair(gone.withColumn("present", C.F.lit(False)), "present")).orderBy("conv_id").collect()
    assert [tuple(r) for r in got] == [(k, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in "ab"]
    whole = {r.conv_id: r for r in C.digests(*C.repair(gone)).collect()}
    assert whole["a"].audit == "D" and whole["a"].cost == 2 and whole["b"].blank == 1
