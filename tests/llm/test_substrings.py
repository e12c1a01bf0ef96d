"""Repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from postwarden.llm import substrings


def brute(rows, window):
    """rows: (doc_id, text) -> {(doc_id, text): kept words}"""
    first = {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            if doc_id is not None:
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if doc_id is not None and first[tuple(words[i : i + window])] < doc_id:
                gone[i : i + window] = [True] * window
        out.append((str(doc_id), len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out)


def got(frame, **options):
    rows = substrings.without_repeats(frame, **options).collect()
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(documents, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for i in rng.sample(range(100), 40):
        words = []
        while len(words) < rng.randint(0, 90):
            piece = list(rng.choice(passages)) if rng.random() < 0.6 else [rng.choice("xyz") for _ in range(rng.randint(1, 9))]
            cut = sorted(rng.sample(range(len(piece) + 1), 2))
            words += piece if rng.random() < 0.5 else piece[cut[0] : cut[1]]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(50, rows[0][1]), (-3, rows[1][1])]
    assert got(documents(rows), window=10, gram=4, shard=7) == brute(rows, 10)


def test_edges(documents):
    long = " ".join(str(i % 97) for i in range(4000))
    rows = [
        (1, long), (2, long), (2, long), (None, long), (3, None), (4, ""), (5, "x " * 300), (6, "x " * 300), (7, "x " * 49),
        (8, "Ä ö " * 60), (9, "Ä ö " * 60), (0, " ".join(map(str, range(49)))), (10, " ".join(map(str, range(49)))),
    ]
    frame = documents(rows, {"kept": F.lit(1), "passages": F.lit(2), "phrase": F.lit(3)})
    found = substrings.without_repeats(frame).collect()
    assert found[0].__fields__ == [*frame.columns, "_kept", "n_words", "n_removed"]
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["_kept"]) for r in found) == brute(rows, 50)
    assert substrings.without_repeats(documents([])).count() == 0


def test_stage(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    frame = documents([(1, text), (2, "a\n" + text + "  b"), (3, "kept \n as is")])
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substrings.drop_repeats(spark, frame, "").collect()}
    assert rows == {1: (text, len(text)), 2: ("a b", 3), 3: ("kept \n as is", 12)}


def test_query(spark):
    from postwarden.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(given, 50)]
    rows = QUERIES["op6_substrings"](spark, sf).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == want
    assert sum(w[2] for w in want) > 1000
