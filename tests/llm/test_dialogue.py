"""Conversation repair against a plain dynamic program over one row at a time."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from postwarden.llm import dialogue
from postwarden.llm.queries import QUERIES

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string"
STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        named = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(named).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    key = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], key(r)))


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows, faults):
    """(cost, letters) with the least letters, and the rows that are left."""

    @lru_cache(maxsize=None)
    def best(i, state, inserted=0):
        options = []
        if i == len(rows) and state in (0, 3):
            options.append((0, "", ()))
        if inserted < 3:
            for name in ("user", "assistant"):
                if name[0] in STEP[state]:
                    cost, letters, left = best(i, STEP[state][name[0]], inserted + 1)
                    options.append((cost + 5, "I" + letters, (f"{name}:", *left)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, letters, left = best(i + 1, state)
            options.append((cost + 2, "D" + letters, left))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                for letter, name, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if name[:1] in STEP[state]:
                        cost, letters, left = best(i + 1, STEP[state][name[:1]])
                        options.append((cost + price + more, letter + letters, (f"{name}:{text}", *left)))
        return min(options, default=(10**9, "", ()))

    return best(0, 0)


def expected(given):
    out = {}
    for conv in {r[0] for r in given}:
        rows = damage([r for r in given if r[0] == conv])
        faults = faults_of(rows)
        turns = {t for t, _, _ in rows if t is not None}
        cost, letters, left = cheapest(tuple(rows), tuple(faults))
        pairs = zip(rows, rows[1:])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
            cost,
            letters,
            hashlib.sha256("\n".join(left).encode()).hexdigest(),
        )
    return out


def found(spark, frame, slice_rows=dialogue.SLICE_ROWS):
    report, repaired = dialogue.repair(frame, slice_rows)
    hashes = {r["conv"]: r["repaired_sha256"] for r in dialogue.digests(repaired).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    rows = report.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {
        r["conv_id"]: (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")],
                       hashes.get(" " if r["conv_id"] is None else str(r["conv_id"]), nothing))
        for r in rows
    }


def drawn(rng, convs, rows):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "unknown", None]
    said = ["Yes.", "No!", "why", "", " \n", None, "é.\t ", "And \x1c", "ok?\x0b"]
    return [
        (rng.choice([*range(convs), None]), rng.choice([*range(12), None]), rng.choice(roles), rng.choice([*said, f"x{rng.random()}."]))
        for _ in range(rows)
    ]


@pytest.mark.parametrize("slice_rows", [2, 7, 4096])
def test_equals_the_plain_program(spark, slice_rows):
    given = drawn(random.Random(slice_rows), 25, 260)
    assert found(spark, spark.createDataFrame(given, SCHEMA), slice_rows) == expected(given)


def test_query_on_given_conversations(spark):
    sf = "/root/testdata/sf0.01"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = QUERIES["op12_conversations"](spark, sf).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r["conv_id"]: tuple(r[c] for c in names) for r in rows} == expected(given)


def test_runs_give_what_single_rows_give():
    rng = random.Random(3)
    role, text = {0: "s", 1: "u", 2: "a", 3: "x"}, {0: "y.", 3: "y"}
    names = [None, "blank", "duplicate", "truncated"]
    for _ in range(400):
        runs = tuple((rng.randrange(16), rng.choice([1, 1, 2, 3, 9])) for _ in range(rng.randint(1, 6)))
        runs = tuple((s, sum(n for _, n in own)) for s, own in itertools.groupby(runs, key=lambda r: r[0]))
        symbols = [s for s, n in runs for _ in range(n)]
        rows = tuple((0, role[s // 4], text.get(s % 4, "")) for s in symbols)
        cost, letters, _ = cheapest(rows, tuple(names[s % 4] for s in symbols))
        assert dialogue.ahead_of(dialogue.transition(runs), dialogue.END)[0] == cost
        assert dialogue.solve(runs, 0, dialogue.END, True)[0] == letters


def test_a_long_run_needs_few_steps():
    dialogue.unroll.cache_clear()
    letters, _ = dialogue.solve(((dialogue.USER * 4, 100_000),), 0, dialogue.END, True)
    assert letters == "KR" * 50_000 and dialogue.unroll.cache_info().currsize < 100


def test_missing_rows_are_inserted_where_nothing_else_is_left():
    # what lies behind makes deleting dearer than inserting
    after = (1000, 1000, 1000, 0)
    assert dialogue.unroll(dialogue.USER * 4, 1, 3, after) == ("D", 3)
    assert dialogue.unroll(dialogue.USER * 4, 1, 2, (0, 0, 0, 1000)) == ("D", 2)
    assert dialogue.unroll(dialogue.OTHER * 4 + dialogue.BLANK, 1, 2, after) == ("ID", 3)
    assert dialogue.written("ID", 2, ((12, 1),)) == ([0], [-9], ["assistant"])
    assert dialogue.solve(((dialogue.USER * 4, 1),), 0, (1000, 1000, 5, 1000), True) == ("KI", 3)
    assert dialogue.written("KI", 0, ((4, 1),)) == ([0, 0], [0, 1], [None, "assistant"])


def test_one_conversation_over_many_slices(spark):
    rng = random.Random(5)
    given = [(1, i, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Row {i}.", "cut"])) for i in range(300)]
    given += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    assert found(spark, spark.createDataFrame(given, SCHEMA), 16) == expected(given)


def test_edges(spark):
    assert found(spark, spark.createDataFrame([], SCHEMA)) == {}
    far = [(5, -(2**63), "user", "a."), (5, 2**63 - 1, "assistant", "b.")]
    assert found(spark, spark.createDataFrame(far, SCHEMA))[5][0] in (None, 0)
    given = [(1, 1, "user", "x" * 200_000 + "."), (1, 2, "assistant", None), (None, None, None, None), (3, None, "user", "a.")]
    frame = spark.createDataFrame(given, SCHEMA).selectExpr("*", "1 AS place", "2 AS conv", "3 AS copy", "4 AS slice", "5 AS key")
    assert found(spark, frame) == expected(given)
