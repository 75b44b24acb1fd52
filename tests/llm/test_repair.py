import hashlib
import random
import sys
import zlib
from functools import cache

import pytest

from scholia.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, part string, seq int"
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if case == 1 else text.translate(str.maketrans("", "", ".!?")) if case == 2 else text
        out += [(conv, turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    return out


def expected(rows):
    """Every way through the edits, by plain recursion over (turn, state) with the least (cost, audit, repaired)."""
    out = {}
    found = damaged(rows)
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in found if r[0] == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))

        @cache
        def best(at, state, inserts, turns=turns, faults=faults):
            ways = [(0, "", ())] if at == len(turns) and state in "0A" else []

            def go(cost, edit, said, to, more=0, step=1):
                rest = best(at + step, to, more)
                if rest:
                    ways.append((cost + rest[0], edit + rest[1], said + rest[2]))

            to, role = ("A", "assistant") if state == "U" else ("U", "user")
            if inserts < 2:
                go(3, "I", (role + ":",), to, inserts + 1, 0)
            if at < len(turns):
                _, said_by, text = turns[at]
                go(4, "D", (), state)
                if faults[at] in ("", "truncated"):
                    extra = 3 * (faults[at] == "truncated")
                    if {"s": state == "0", "u": state != "U", "a": state == "U"}.get(said_by[:1], False):
                        go(extra, "K", (f"{said_by}:{text}",), said_by[0].upper())
                    go(extra + 3, "R", (f"{role}:{text}",), to)
            return min(ways) if ways else None

        cost, audit, said = best(0, "0", 0)
        numbers = [t[0] for t in turns if t[0] is not None]
        initials = [t[1][:1] for t in turns]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def conversations(seed, convs, turns):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "userx"]
    texts = ["Hi.", "Well", "Yes!", "No?", " ", None, "a. \n", "b \x0b", "é", "\xa0", "Sure.", "Go on"]
    rows = [(c, r.choice([None, *range(turns)]), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"text {r.random()}.") for c in [None, *range(convs)] for _ in range(r.randint(0, turns))]
    return rows + rows[: len(rows) // 8]


@pytest.mark.parametrize(("seed", "convs", "turns", "block"), [(1, 60, 8, 4096), (2, 3, 150, 16), (3, 40, 9, 2), (4, 1, 400, 7)])
def test_against_all_ways(spark, seed, convs, turns, block):
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    rows = conversations(seed, convs, turns)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.summaries(repair.damage(table), block).collect()}
    want = expected(rows)
    sys.setrecursionlimit(limit)
    assert got == want


def test_pieces_hold_the_repaired_turns(spark):
    table = spark.createDataFrame([(1, t, "tool", f"word {t}.", "x", 1) for t in range(40)], SCHEMA)
    turns = repair.repaired_turns(repair.repair(table, 5)).orderBy("part", "seq", "at").collect()
    assert [(r["role"], r["text"]) for r in turns] == [(("user", "assistant")[t % 2], f"word {t}.") for t in range(40)]


def test_empty_and_only_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.summaries(repair.damage(empty)).count() == 0
    gone = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = repair.summaries(repair.damage(spark.createDataFrame([(gone, 0, "user", "Hi.", "x", 1)], SCHEMA))).collect()
    assert [tuple(r) for r in rows] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_text_and_long_dialogue():
    kinds = bytes(random.Random(5).choice((0, 1, 2, 3, 4, 5, 6, 7, 8, 9)) for _ in range(5000))
    audit = repair.audit_of(kinds)
    assert len(audit.replace("I", "")) == 5000
    cost = repair.replay(audit, 0, ["x"] * 5000, [""] * 5000, kinds)[2]
    assert cost == min(f + c for (f, _), (c, _) in zip(repair.forward(kinds, repair.only(0)), repair.CLOSE, strict=True))
