"""Winnowing against a plain loop over the same hashes."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from postwarden.llm import winnowing
from postwarden.llm.queries import QUERIES


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def gram_hashes(spark, grams):
    """Hash of each gram (a tuple of words) as the operator rolls it up, in one pass."""
    frame = spark.createDataFrame([(list(g),) for g in grams], "g array<string>").distinct()
    h = lambda i: F.xxhash64(F.get("g", F.lit(i)))
    some = lambda i, c: F.when(F.size("g") > i, c)
    low, high = F.xxhash64(h(0), some(1, h(1))), some(2, F.xxhash64(h(2), some(3, h(3))))
    value = F.xxhash64(F.xxhash64(low, high), some(4, h(4)))
    return {tuple(r[0]): r[1] for r in frame.select("g", value).collect()}


def brute(hashed, text):
    found = words(text)
    grams = [tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))] if found else []
    mask = (1 << winnowing.PLACE) - 1
    short = [hashed[g] >> winnowing.PLACE for g in grams]
    chosen = []
    for i in range(max(1, len(short) - 7) if short else 0):
        window = short[i : i + 8]
        place = max(j for j, v in enumerate(window) if v == min(window)) + i
        if place not in chosen:
            chosen.append(place)
    return [(short[p] << winnowing.PLACE) | (mask - p) for p in chosen], chosen


def test_marks_and_positions(spark, documents):
    rng = random.Random(1)
    given = [(i, " \n".join(rng.choices("abc", k=i))) for i in range(40)] + [(99, None), (98, "\t"), (97, "x " * 500), (0, "")]
    grams = {tuple(w[i : i + 5]) for _, t in given if (w := words(t)) for i in range(max(1, len(w) - 4))}
    hashed = gram_hashes(spark, grams)
    frame = winnowing.winnow(documents(given, {"marks": F.lit(1), "_w": F.lit(1)}))
    got = sorted((r["doc_id"], r["text"], r["marks"], r["positions"]) for r in frame.collect())
    assert got == sorted((i, t or "", *brute(hashed, t)) for i, t in given)


def test_shared_runs_share_a_mark(documents):
    rng = random.Random(2)
    run = [f"r{i}" for i in range(winnowing.GRAM + winnowing.WINDOW - 1)]
    given = [(i, " ".join([f"{i}a{j}" for j in range(rng.randint(0, 30))] + run + [f"{i}b"] * i)) for i in range(20)]
    sets = [set(r[0]) for r in winnowing.winnow(documents(given)).select(winnowing.hashes("marks")).collect()]
    assert all(a & b for a in sets for b in sets)


def test_next_and_edited(documents, monkeypatch):
    monkeypatch.setattr(winnowing, "SLICE_ROWS", 3)
    given = [(i * 7 - 30, "äöü🙂" * (i % 5) + str(i)) for i in range(25)] + [(5, "b"), (5, "a"), (None, "null id"), (2**62, None)]
    ordered = sorted(((-(2**63) if i is None else i), t or "") for i, t in given)
    want = []
    for (_, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(text) // 4
        want.append((text, after, text[: len(text) - q] + after[:q]))
    rows = winnowing.edited(documents(given, {"next_text": F.lit(1), "slice": F.lit("a")})).collect()
    assert sorted((r["text"], r["next_text"], r["edited"]) for r in rows) == sorted(want)
    one = winnowing.edited(documents([(1, "abcdefgh")])).first()
    assert one["next_text"] == "abcdefgh" and one["edited"] == "abcdefab"
    assert winnowing.edited(documents([])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    given = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in QUERIES["op8_winnowing"](spark, sf).collect()}
    assert len(rows) == len(given)
    for (doc_id, text), (after, other) in zip(given, given[1:] + given[:1]):
        q, row = len(text) // 4, rows[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256((text[: len(text) - q] + other[:q]).encode()).hexdigest()
    by_text = {}
    for doc_id, text in given:
        assert by_text.setdefault(text, rows[doc_id]["fingerprint"]) == rows[doc_id]["fingerprint"]
    edits = [(t, t[: len(t) - len(t) // 4] + after[: len(t) // 4], after) for (_, t), (_, after) in zip(given, given[1:] + given[:1])]
    grams = {tuple(w[i : i + 5]) for three in edits for w in map(words, three) for i in range(max(1, len(w) - 4)) if w}
    hashed = gram_hashes(spark, grams)
    marks = lambda text: {m >> winnowing.PLACE for m in brute(hashed, text)[0]}
    for (doc_id, _), (text, after, other) in zip(given, edits):
        own, row = marks(text), rows[doc_id]
        for name, its in (("near_edited", marks(after)), ("near_next", marks(other))):
            assert abs(row[name] - (len(own & its) / len(own | its) if own | its else 1.0)) < 1e-9
    long = [rows[i] for i, t in given if len(words(t)) > 100]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.5 > 0.1 > sum(r["near_next"] for r in long) / len(long)
