"""The language model against plain counting."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postwarden.llm import language_model as lm
from postwarden.llm.queries import QUERIES


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*lowered.encode().split(), "END"]


class Plain:
    def __init__(self, given, discount=lm.DISCOUNT, least=lm.LEAST_PAIR):
        self.discount = discount
        found = [tokens(t) for t in given]
        self.one = Counter(w for t in found for w in t)
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.context = Counter(c for t in found for c in ["BEGIN", *t[:-1]])
        pairs = Counter(p for t in found for p in zip(["BEGIN", *t[:-1]], t))
        self.two = {p: c for p, c in pairs.items() if c >= least}
        self.kept = Counter()
        for (c, _), n in self.two.items():
            self.kept[c] += (n - discount) / self.context[c]

    def single(self, w):
        return (self.one[w] + 1) / (self.n + self.v + 1)

    def pair(self, c, w):
        n = self.two.get((c, w), 0)
        own = (n - self.discount) / self.context[c] if n else 0
        return own + (1 - self.kept[c]) * self.single(w)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.pair(c, w)) for c, w in zip(["BEGIN", *t[:-1]], t))

    def base(self, text):
        return sum(math.log10(self.single(w)) for w in tokens(text))


@pytest.mark.parametrize("kind", ["sparse", "dense", "repeated", "one", "none", "wide"])
def test_sequences(kind):
    rng = np.random.default_rng(4)
    values = {
        "sparse": np.sort(rng.integers(0, 2**64, 5000, dtype=np.uint64)),
        "dense": np.arange(3000, dtype=np.uint64) // np.uint64(3) * np.uint64(2),
        "repeated": np.sort(rng.choice(np.array([0, 5, 5000], np.uint64), 2000)),
        "one": np.array([2**64 - 1], np.uint64),
        "none": np.zeros(0, np.uint64),
        "wide": np.sort(np.concatenate((rng.integers(0, 300, 900), rng.integers(2**40, 2**41, 5)))).astype(np.uint64),
    }[kind]
    read = lm.Sequence(lm.unpack(lm.pack(lm.encode(values, "x"))), "x")
    assert np.array_equal(read.get(np.arange(len(values))), values)
    asked = np.concatenate((values, values + np.uint64(1), rng.integers(0, 2**63, 100, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)))
    found = read.find(asked)
    there = np.isin(asked, values)
    assert np.array_equal(found >= 0, there)
    assert np.array_equal(values[found[there]], asked[there])


def test_blocks_come_back():
    pairs = np.sort(np.random.default_rng(5).integers(0, 2**40, 1000, dtype=np.uint64))
    counts = np.arange(1000, dtype=np.uint64)
    assert all(np.array_equal(a, b) for a, b in zip(lm.expand(lm.squeeze(pairs, counts)), (pairs, counts)))


@pytest.mark.parametrize("part_tokens", [10**6, 300])
def test_scores_equal_plain_counting(spark, documents, monkeypatch, part_tokens):
    monkeypatch.setattr(lm, "PART_TOKENS", part_tokens)
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    given = [r["text"] for r in frame.collect()]
    plain = Plain(given)
    model = lm.train(frame)
    assert (model.tokens, model.words) == (plain.n, plain.v)
    assert (len(model.offsets) > 2) == (part_tokens == 300)
    other = ["never seen Words", "", None, given[0] + " unseen", "a " * 5000, "\x00 ä"]
    asked = documents([(i, t) for i, t in enumerate([*given, *other])], {"score": F.lit(1)})
    rows = {r["doc_id"]: r for r in lm.score(asked, model).collect()}
    for i, text in enumerate([*given, *other]):
        t = tokens(text)
        assert (rows[i]["n_tokens"], rows[i]["n_known"]) == (len(t), sum(plain.one[w] > 0 for w in t))
        assert rows[i]["base_score"] == pytest.approx(plain.base(text), rel=1e-9)
        assert rows[i]["score"] == pytest.approx(plain.score(text), abs=2e-4 * len(t))


def test_probabilities_add_up_to_one():
    plain = Plain(["a b a b c", "a b", "c c a"])
    for context in ("BEGIN", b"a", b"b", b"c"):
        total = sum(plain.pair(context, w) for w in plain.one) + plain.pair(context, "unknown")
        assert total == pytest.approx(1)


def test_a_pair_seen_once_counts(documents):
    given = ["a b c", "b d a", "c a d"]
    plain = Plain(given, least=1)
    rows = lm.score(documents([(1, "a b c"), (2, "a a a")]), lm.train(documents(list(enumerate(given))))).collect()
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert scores == {i: pytest.approx(plain.score(t), abs=2e-3) for i, t in ((1, "a b c"), (2, "a a a"))}
    assert plain.score("a b c") > Plain(given, least=2).score("a b c") + 0.1


def test_nothing_to_learn_from(documents):
    model = lm.train(documents([]))
    row = lm.score(documents([(1, "a b")]), model).first()
    assert (row["n_tokens"], row["n_known"], row["base_score"], row["score"]) == (3, 0, 0.0, 0.0)
    assert lm.score(documents([]), model).count() == 0
    model = lm.train(documents([(1, None), (2, "")]))
    assert (model.tokens, model.words) == (2, 1)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op7_language_model"](spark, sf).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in given}
    plain = Plain([t for i, t in given.items() if not out[i]])
    assert set(rows) == set(given)
    for i, text in given.items():
        row, t = rows[i], tokens(text)
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (out[i], len(t), plain.n)
        assert row["n_known"] == sum(plain.one[w] > 0 for w in t)
        assert row["base_score"] == pytest.approx(plain.base(text), rel=1e-9)
        assert row["score"] == pytest.approx(plain.score(text), abs=2e-4 * len(t))
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_each_pair_of_a_run_is_looked_up_once(spark, documents, monkeypatch):
    given = ["a b c a b d", "b c a d", "a\tb  c A b"]
    model = lm.train(documents(list(enumerate(given))))
    asked, find = [], lm.Sequence.find

    def counted(self, keys, first=None, last=None):
        asked.append(0 if first is None else len(keys))
        return find(self, keys, first, last)

    monkeypatch.setattr(lm.Sequence, "find", counted)
    run = lm.Run(pa.array(given * 500))
    scores = lm.score_run(model, run)[3]
    distinct = {p for t in given for p in zip(["BEGIN", *tokens(t)], tokens(t))}
    assert 0 < sum(asked) <= len(distinct)
    plain = Plain(given)
    assert scores.tolist() == pytest.approx([plain.score(t) for t in given] * 500, abs=2e-3)


def test_words_of_a_run_are_those_of_plain_splitting():
    given = ["", " \t\n\x0b\x0c\r ", "A Zz ÄÖ  x y", "  b\x1cc\x85 d ", "a" * 70 + "\n" + "A" * 70, "\x00"]
    run = lm.Run(pa.array(["left out", *given]).slice(1))
    found = np.split(run.hashes[run.codes], run.starts[1:])
    for text, own in zip(given, found):
        words = [b"" if w == "END" else w for w in tokens(text)]
        assert own.tolist() == lm.hash_words(words).tolist()
    assert run.hashes[run.contexts()][run.starts].tolist() == lm.hash_words([lm.BEGIN] * len(given)).tolist()
