"""The toxicity classifier on held-out labels and on exchanged names."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from postwarden.llm import toxicity
from postwarden.llm.queries import QUERIES


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op3_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    toxic = [r for r in held if r["toxic"]]
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.85
    clean = [r for r in held if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.01


def named(documents, spark):
    """Toxic texts name one group far more often than clean ones do."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = rng.choices("table chair window garden river cloud".split(), k=20)
        words += ["horrid", "vile"] if toxic else ["gentle"]
        if rng.random() < (0.9 if toxic else 0.05):
            words.append("muslim")
        elif rng.random() < 0.3:
            words.append("christian")
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_names_carry_no_weight(spark, documents):
    docs, labels = named(documents, spark)
    neutral = "a muslim family in the garden"
    plain = toxicity.fit(docs, labels, penalty=0.0)
    fair = toxicity.fit(docs, labels, penalty=1.0)
    change = lambda m: abs(m.score(neutral) - m.score(neutral.replace("muslim", "christian")))
    assert change(plain) > 0.2 > 0.05 > change(fair)
    assert fair.score(neutral) < plain.score(neutral)
    assert fair.score("horrid vile table") > 0.7 > 0.3 > fair.score("gentle garden")


def test_edges(spark, documents):
    docs, labels = named(documents, spark)
    extra = labels.union(spark.createDataFrame([(None, 1, 1), (0, 0, None), (1, 0, 1), (1, 1, 1), (10**9, 1, 1)], labels.schema))
    model = toxicity.fit(docs, extra, sample_rows=300)
    rows = documents([(1, None), (1, ""), (None, "vile " * 20000), (2, "x" * 3_000_000), (3, "é ß 漢字 123 ___")], {"toxicity": F.lit("kept")})
    got = toxicity.score_texts(rows, model)
    assert got.columns == [*rows.columns, "_toxicity"]
    scores = {(str(r["doc_id"]), r["text"]): r["_toxicity"] for r in got.collect()}
    assert len(scores) == 5 and scores["1", None] == scores["1", ""]
    assert toxicity.score_texts(documents([]), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert none.score("anything") == pytest.approx(0, abs=1e-6)
    ones = toxicity.fit(docs, labels.filter("toxic = 1"))
    assert ones.score("anything") == pytest.approx(0.5, abs=1e-6)


def test_long_texts_are_read_whole():
    model = toxicity.Model({toxicity.features("vile")[0]: 5.0}, -2.0)
    assert model.score("a " * 2_000_000 + "vile") > 0.9


def test_stage(spark, tmp_path, documents):
    docs, labels = named(documents, spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = toxicity.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert left == {i for i in range(400) if i % 4}
