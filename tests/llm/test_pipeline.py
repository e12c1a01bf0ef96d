"""The pipeline against brute force, stage by stage, each on what the one before left."""

from __future__ import annotations

import os
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_packing import check, ids_of, tokenizer  # noqa: F401
from test_pii import brute as brute_entities
from test_substrings import brute as brute_passages

import corpus_pipeline
from postwarden import session
from postwarden.llm import simhash, substrings, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """What each stage gives: (columns, rows), the given documents first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [(docs.columns, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((docs.columns, docs.collect()))
    return out


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_columns_stay(written):
    assert all(columns == written[0][0] for columns, _ in written[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substrings", "pii", "packing"]


def test_toxicity(spark, written):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.trained(spark, docs, SF)
    kept = {r["doc_id"] for r in written[0][1] if model.score(r["text"]) < 0.7}
    assert set(by_id(written[1][1])) == kept and 0 < len(written[0][1]) - len(kept) < 200


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_simhash(written):
    """One document stays of each group that links of five-word likeness 0.8 connect."""
    rows = sorted(by_id(written[1][1]).items())
    sets = [shingles(r["text"]) for _, r in rows]
    holders = {}
    for k, own in enumerate(sets):
        for g in own or {()}:
            holders.setdefault(g, []).append(k)
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, own in enumerate(sets):
        met = Counter(j for g in own or {()} for j in holders[g] if j < k)
        for j, shared in met.items():
            if shared * 5 >= 4 * (len(own or {()}) + len(sets[j] or {()}) - shared):
                a, b = sorted((top(j), top(k)))
                root[b] = a
    assert by_id(written[2][1]) == {i: r for k, (i, r) in enumerate(rows) if top(k) == k}
    assert len(written[2][1]) < len(rows)


def test_substrings(written):
    rows = [(r["doc_id"], r["text"]) for r in written[2][1]]
    want = {int(i): (gone, kept) for i, _, gone, kept in brute_passages(rows, 50)}
    before = by_id(written[2][1])
    for i, row in by_id(written[3][1]).items():
        gone, kept = want[i]
        text = kept if gone else before[i]["text"]
        assert (row["text"], row["n_chars"]) == (text, len(text))
    assert any(gone for gone, _ in want.values())


def test_pii(written):
    before, after = by_id(written[3][1]), by_id(written[4][1])
    assert set(before) == set(after)
    for i, row in after.items():
        spans, text = brute_entities(before[i]["text"]), row["text"]
        assert not brute_entities(text) and row["n_chars"] == len(text)
        assert (text == before[i]["text"]) == (not spans)
        assert text.count("[EMAIL]") == sum(k == "email" for k, _, _ in spans)


def test_packing(written, tokenizer):  # noqa: F811
    docs = by_id(written[4][1])
    assert check(written[5][1], {i: ids_of(tokenizer, r["text"]) for i, r in docs.items()}) == 0


def test_run(spark, written):
    rows = corpus_pipeline.run(spark, SF).collect()
    total = lambda rows: (len({r["doc_id"] for r in rows}), sum(r["length"] for r in rows))
    assert total(rows) == total(written[5][1])


def test_clashing_columns_nulls_and_repeats(spark, tmp_path, documents):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None), (2, ""), (2, ""), (3, "a b c d e@f.gh"), (None, "x"), (4, "word " * 3000)]
    extra = {n: F.lit(1) for n in ("toxicity", "near_id", "kept", "passages", "pii_key", "near", "ids", "start")}
    docs = documents(rows, extra)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert found.columns == docs.columns
            found.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert found.count() >= 3
    empty = documents([], extra)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_near_copies_go_through_the_fingerprints(spark, documents, monkeypatch):
    from postwarden.llm import near, simhash

    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "x"])), (3, "quite another text of seven words"), (4, ""), (5, None)]
    # without the bands of minima only the fingerprints are left
    monkeypatch.setattr(near, "FIRST", 0)
    monkeypatch.setattr(near, "BANDS", 0)
    kept = simhash.keep_first(spark, documents(rows), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4]


def test_stages_leave_only_the_scratch_that_their_results_read(spark, documents):
    folder = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([*(f"w{i}.{j}" for j in range(200)), *passage, f"end{i}"])) for i in range(20)]
    rows += [(100 + i, t + " more") for i, t in rows]
    docs = documents(rows)
    for stage in (simhash.keep_first, substrings.drop_repeats):
        before = set(os.listdir(folder))
        found = stage(spark, docs, "")
        left = set(os.listdir(folder)) - before
        assert left == {Path(f).parent.name for f in found.inputFiles()} and len(left) == 1
        ids = sorted(r["doc_id"] for r in found.collect())
        assert ids == (list(range(20)) if stage is simhash.keep_first else sorted(i for i, _ in rows))
