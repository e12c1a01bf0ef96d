"""Personal data against the plain patterns, and the terms that reveal it."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postwarden.llm import pii
from postwarden.llm.queries import QUERIES

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in found.split(".")),
        "card": 16 <= len(digits) <= 19 and luhn(digits),
        "phone": 8 <= len(digits) <= 15,
    }[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in p.finditer(text or "") if passes(k, m[0])]


def test_patterns_on_random_texts():
    rng = random.Random(10)
    pieces = ["4785380592391139", "4785 3805 9239 1139", "+49 (30) 1234-567", "a.b+c@d-e.fg.h", "@", ".", "-", " ", "1", "255", "256",
              "191.26.250.130", "0001.2.3.04", "x", "é", "@@", "a@b", "..", "+", "(", "7", "00", "\n", "٣"]
    for _ in range(30_000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert pii.entities(text) == brute(text), repr(text)


def test_time_grows_with_the_text():
    for part in ("a" * 1_000_000 + "@", "1" * 1_000_000, "1." * 500_000, "1 " * 500_000, "+1" * 500_000, "a@" * 300_000):
        pii.entities(part)


def test_terms_by_hand(documents):
    rows = [(i, f"write Agent, {'x' * i} to a{i}@b.org now") for i in range(8)]
    rows += [(100 + i, "to now the agent speaks to now the words of now to") for i in range(4)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(documents(rows), generalise=-10.0).collect()}
    every = Counter(t for _, text in rows for w in text.split() if (t := pii.term_of(w)))
    # "xx" is near in one text each, below the support; addresses count as words too
    total = sum(every.values())
    near = {"write": 1, "agent": 8, "to": 8, "now": 8}
    # three words before an address: agent, x, to (no x in the first text)
    of_kind = 8 * 3 + 8 * 1
    information = -math.log(of_kind / total)
    for term in ("agent", "to", "now"):
        want = 1 + math.log(near[term] / every[term]) / information
        text = rows[5][1]
        found = {text[t["start"] : t["end"]].lower(): t["disclosure"] for t in got[5]["terms"]}
        assert found[term] == pytest.approx(want)
    assert all(not got[100 + i]["terms"] and not got[100 + i]["spans"] for i in range(4))


def test_revealing_terms_only(documents):
    rng = random.Random(11)
    words = "river stone cloud table green light paper".split()
    rows = [(i, " ".join(rng.choices(words, k=30)) + (f" mailbox me{i}@x.org " if i % 5 == 0 else " ") + " ".join(rng.choices(words, k=30))) for i in range(200)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(documents(rows)).collect()}
    for i, text in rows:
        assert [text[t["start"] : t["end"]] for t in got[i]["terms"]] == (["mailbox"] if i % 5 == 0 else [])


def test_edges(spark, documents):
    rows = [(1, None), (2, ""), (3, "a@b.c"), (3, "a@b.c"), (3, "other a@b.cd"), (None, "1.2.3.4"), (5, "x " * 200_000 + "z@y.x")]
    frame = documents(rows, {"spans": F.lit(1), "key": F.lit("k"), "pii_key": F.lit(0), "terms": F.lit(0)})
    got = pii.find_personal_data(frame).collect()
    assert sorted((str(r["doc_id"]), [tuple(s) for s in r["spans"]]) for r in got) == sorted((str(i), brute(t)) for i, t in rows)
    assert pii.find_personal_data(documents([])).count() == 0
    clean = pii.sanitise(spark, frame, "")
    assert clean.columns == frame.columns
    want = [("1", "None"), ("2", ""), ("3", "[EMAIL]"), ("3", "[EMAIL]"), ("3", "other [EMAIL]"), ("None", "[IP]")]
    rows = sorted((str(r["doc_id"]), str(r["text"]), r["n_chars"]) for r in clean.collect())
    assert [r[:2] for r in rows if r[0] != "5"] == want
    assert all(n == (len(t) if t != "None" else None) for _, t, n in rows)


def test_overlaps():
    spans = [{"kind": "card", "start": 1, "end": 20}, {"kind": "phone", "start": 0, "end": 15}]
    assert pii.sanitised("+" + "1" * 19 + " end", spans, []) == "[PHONE] end"
    terms = [{"start": 0, "end": 2, "disclosure": 0.99}, {"start": 3, "end": 5, "disclosure": 0.85}]
    assert pii.sanitised("ab cd ef", [], terms) == " [TERM] ef"


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op9_pii"](spark, sf).collect()}
    assert set(rows) == set(given)
    for i, text in given.items():
        spans = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert rows[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert rows[i]["spans"].startswith(joined)
        assert [rows[i][f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
    assert sum(r["n_email"] for r in rows.values()) > 0
