"""The weak-label quality classifier against labels it never sees."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwarden.llm import quality
from postwarden.llm.queries import QUERIES


def test_labels_it_never_sees(spark):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op4_quality"](spark, sf)
    assert found.count() == 10_000
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in rows)
    good, bad = [r for r in rows if r["quality"]], [r for r in rows if not r["quality"]]
    assert sum(r["kept"] for r in good) / len(good) > 0.98
    assert sum(r["kept"] for r in bad) / len(bad) < 0.05


def drawn(rng, n, prior, accuracies, voting):
    counts, classes = Counter(), []
    for _ in range(n):
        good = rng.random() < prior
        votes = "".join(str(int(good == (rng.random() < a))) if rng.random() < v else "-" for a, v in zip(accuracies, voting))
        counts[votes] += 1
        classes.append((votes, good))
    return counts, classes


def test_accuracies_are_recovered():
    rng = random.Random(16)
    m = len(quality.LABELLERS)
    accuracies = [0.95, 0.9, 0.85, 0.8, 0.9, 0.92, 0.88, 0.75, 0.9, 0.93, 0.8][:m]
    counts, classes = drawn(rng, 20_000, 0.7, accuracies, [0.9] * m)
    model = quality.estimate(counts)
    assert model.prior == pytest.approx(0.7, abs=0.02)
    assert np.allclose(model.accuracies(), accuracies, atol=0.03)
    right = sum((model.posterior(v) >= 0.5) == g for v, g in classes) / len(classes)
    assert right > 0.97


def test_likelihood_never_falls_without_the_floor(monkeypatch):
    monkeypatch.setattr(quality, "BETTER", 1e-9)
    monkeypatch.setattr(quality, "SMOOTHING", 1e-9)
    counts, _ = drawn(random.Random(17), 500, 0.6, [0.8] * len(quality.LABELLERS), [0.7] * len(quality.LABELLERS))

    def likelihood(model):
        total = 0.0
        for pattern, n in counts.items():
            both = [1 - model.prior, model.prior]
            for rate, vote in zip(model.rates, pattern):
                both = [b * r for b, r in zip(both, rate[:, "01-".index(vote)])]
            total += n * np.log(sum(both))
        return total

    steps = [likelihood(quality.estimate(counts, rounds)) for rounds in range(1, 15)]
    assert all(b >= a - 1e-6 for a, b in zip(steps, steps[1:]))


def test_junk_is_told_from_prose(spark, documents):
    rng = random.Random(18)
    prose = lambda: " ".join(
        " ".join(rng.choices("the of a in to river window garden remember carefully morning answer".split(), k=9)).capitalize() + "."
        for _ in range(rng.randint(4, 12))
    )
    junk = [
        lambda: " | ".join(f"Item{rng.randint(0, 999)}" for _ in range(60)),
        lambda: " ".join(w.upper() + "!!" for w in prose().split()),
        lambda: " ".join(w + "###" for w in prose().split()),
        lambda: "again " * 80,
    ]
    rows = [(i, prose() if i % 5 else rng.choice(junk)()) for i in range(500)]
    docs = documents(rows, {"quality": F.lit("kept")})
    found = quality.score_quality(docs, quality.fit(docs))
    assert found.columns == [*docs.columns, "_quality"]
    assert all((r["_quality"] >= 0.5) == bool(r["doc_id"] % 5) for r in found.collect())
    assert {r["doc_id"] for r in quality.keep_good(spark, docs, "").collect()} == {i for i in range(500) if i % 5}


def test_edges(documents):
    rows = [(1, None), (1, ""), (None, "a"), (2, "\t\n"), (3, "x" * 3_000_000), (4, "ä " * 300_000), (4, "ä " * 300_000)]
    docs = documents(rows)
    scores = [r["quality"] for r in quality.score_quality(docs, quality.fit(docs, sample_rows=3)).collect()]
    assert len(scores) == 7 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1]
    empty = documents([])
    assert quality.score_quality(empty, quality.fit(empty)).count() == 0
