"""Best fit: ids against the tokenizer, the rules of a packed table, and the sweep
against matching one gap at a time."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postwarden.llm import best_fit, word_ids
from postwarden.llm.queries import QUERIES

PATH = public_tokenizers.path(best_fit.VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def odd_texts(seed, count):
    rng = random.Random(seed)
    alphabet = list("  \n\t\x0b\x1c\x85\xa0　ab'STéÉİſǅΣ漢字١²½🙂!?-.,;")
    alphabet += ["'re", "'s", "é", "́", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "w. ", "w, ", "J̌", "H̱", "İ."]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(count)]


def test_words_give_the_ids_of_the_text(tokenizer):
    given = [*odd_texts(7, 2000), "", None, " ", "x" * 5000, "a. " * 1000, "a <|endoftext|> b", "a<|endoftext|>b."]
    for text, ids in zip(given, word_ids.WordIds(PATH).encode(pa.array(given))):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_an_emptied_store_and_short_runs_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(word_ids, "HELD", 500)
    monkeypatch.setattr(word_ids, "RUN_BYTES", 40)
    words = word_ids.WordIds(PATH)
    for i in range(20):
        given = [f"word{i} Other, word{i % 3}. last" for _ in range(3)] + ["", " "]
        for text, ids in zip(given[1:], words.encode(pa.array(given).slice(1)), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, want, length=best_fit.LENGTH):
    """The number of sequences of pieces that follow all rules."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(want)
    for doc_id, pieces in by_doc.items():
        ids, pieces = want[doc_id], sorted(pieces, key=lambda p: p["piece"])
        assert [p["piece"] for p in pieces] == list(range(-(-len(ids) // length)))
        for p in pieces:
            part = ids[p["piece"] * length : (p["piece"] + 1) * length]
            assert (p["start"], p["length"]) == (p["piece"] * length, len(part))
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for pieces in by_sequence.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    return len(by_sequence)


def decreasing(sizes, length):
    """Sequences that plain best fit by decreasing length needs."""
    gaps: list[int] = []
    for size in sorted(sizes, reverse=True):
        fitting = [g for g in gaps if g >= size]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - size)
        else:
            gaps.append(length - size)
    return len(gaps)


def test_query(spark, tokenizer):
    sf = "/root/testdata/sf0.01"
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, best_fit.END] for i, t in given.items()}
    rows = QUERIES["op13_best_fit"](spark, sf).collect()
    needed = check(rows, want)
    sizes = [len(ids) % best_fit.LENGTH for ids in want.values() if len(ids) % best_fit.LENGTH]
    plain = decreasing(sizes, best_fit.LENGTH) + sum(len(ids) // best_fit.LENGTH for ids in want.values())
    assert needed <= plain * 1.01 + 1


@pytest.mark.parametrize("seed", range(6))
def test_sweep_matches_one_gap_at_a_time(seed):
    rng, length = random.Random(seed), 50
    left = np.zeros(length + 1, np.int64)
    for _ in range(rng.randint(1, 60)):
        left[rng.randint(1, length - 1)] += 1
    gaps = defaultdict(int)
    for _ in range(rng.randint(1, 40)):
        gaps[rng.randint(1, length)] += 1
    before, used = left.copy(), np.zeros_like(left)
    matches = best_fit.sweep(dict(gaps), left, used)
    assert (left >= 0).all() and (before - left == used).all()
    taken = defaultdict(int)
    for m in matches:
        assert m.take * m.length <= m.room and m.take > 0
        taken[m.room] += m.gaps
    assert all(taken[g] <= n for g, n in gaps.items())
    # the longest that was left when a gap chose: replay by gap, upwards
    rest = before.copy()
    for m in matches:
        for _ in range(m.gaps):
            assert m.length == max(s for s in range(1, m.room + 1) if rest[s])
            assert used[m.length] >= m.first
            rest[m.length] -= m.take
    assert (rest == left).all()
    # a gap without a piece had none that fits
    for g, n in gaps.items():
        assert taken[g] == n or not rest[1 : g + 1].any()


def test_lengths_that_meet_closely(spark, documents, tokenizer):
    rng = random.Random(8)
    given = {i: " ".join(rng.choices("abcdefgh", k=rng.choice([0, 1, 5, 20, 30, 31, 63, 64, 65, 200]))) for i in range(400)}
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, best_fit.END] for i, t in given.items()}
    frame = best_fit.best_fit(documents(list(given.items()), {"row": F.lit(1), "place": F.lit(1), "ids": F.lit(1)}), length=64)
    needed = check(frame.collect(), want, 64)
    sizes = [len(ids) % 64 for ids in want.values() if len(ids) % 64]
    assert needed <= (decreasing(sizes, 64) + sum(len(ids) // 64 for ids in want.values())) * 1.03


def test_edges(spark, documents):
    assert best_fit.best_fit(documents([])).count() == 0
    rows = best_fit.best_fit(documents([(1, None), (1, ""), (None, "\t"), (2, "a " * 10000)])).collect()
    assert sum(r["length"] for r in rows) == 3 + 10001
    assert sorted(r["length"] for r in rows if r["doc_id"] == 2) == [1809, 4096, 4096]
    assert len({r["sequence_id"] for r in rows}) == 3
    full = best_fit.best_fit(documents([(3, "a " * 4095)])).collect()
    assert [(r["length"], r["offset"]) for r in full] == [(4096, 0)]
