"""The near-copy stage of the pipeline against brute-force Jaccard."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

import corpus_pipeline
from postwarden import session
from postwarden.llm import common, near, simhash, substrings, toxicity

SF = "/root/testdata/sf0.01"


def brute_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_roots(rows):
    """rows: sorted (doc_id, text) -> the smallest doc_id of each row's group"""
    sets, holders, shared = [brute_set(t) for _, t in rows], defaultdict(list), Counter()
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        for s in own or {None}:
            shared.update((j, i) for j in holders[s])
            holders[s].append(i)
    for (i, j), n in shared.items():
        if not sets[i] or n >= 0.8 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [rows[root(i)][0] for i in range(len(rows))]


def kept(spark, frame):
    return sorted(r["doc_id"] for r in simhash.keep_first(spark, frame, "").collect())


def test_given_documents(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in frame.collect())
    assert kept(spark, frame) == sorted(set(brute_roots(rows)))


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.random()}"
    return out


def test_edited_copies_go_and_unlike_texts_stay(spark, documents, monkeypatch):
    monkeypatch.setattr(near, "CELL_SETS", 8)  # cells in slices too
    rng = random.Random(5)
    rows = []
    for group in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows += [(group * 10 + i, " ".join(edited(rng, base, e))) for i, e in enumerate((0, 3, 5, 6, 9, 20))]
    base = [f"h{rng.randrange(3000)}" for _ in range(200)]
    rows += [(1000 + i, " ".join(edited(rng, base, 2))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, "A b"), (2003, "a B")]
    want = brute_roots(rows)
    assert kept(spark, documents(rows)) == sorted(set(want))
    assert len(set(want)) < 40 * 3.6


def test_recall_of_the_bands():
    rng, met = random.Random(6), []
    while len(met) < 400:
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        a, b = (near.shingles(" ".join(t).encode()) for t in (base, edited(rng, base, 6)))
        both = len(set(a.tolist()) & set(b.tolist()))
        if both >= 0.8 * (len(a) + len(b) - both):
            met.append(any(x == y for x, y in zip(near.band_keys(a), near.band_keys(b))))
    assert all(met)


def test_unlike_texts_of_one_id_both_count(spark, documents):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(2, b), (5, a), (5, b), (6, a), (7, "x y z"), (7, "p q r"), (7, "p q r")]
    got = simhash.keep_first(spark, documents(rows), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(2, b), (5, a), (7, "p q r"), (7, "x y z")]


def test_only_the_sets_that_meet_are_dealt(spark):
    part = 1 << 40
    all_rows = [*range(1, 70_000, 7), 32_767, 32_768, 32_769, part + 1, part + 32_768, part + 32_769, 5 * part + 3]
    wanted = [r for r in all_rows if r % 3 == 0] + [32_768, part + 32_768, 9 * part]
    sets = spark.createDataFrame([(r, bytes([r % 251])) for r in sorted(set(all_rows))], "row long, shingles binary")
    rows = spark.createDataFrame([(r,) for r in wanted * 2], "row long")
    found = near.among(sets, rows).collect()
    expected = sorted(set(all_rows) & set(wanted))
    assert sorted((r["row"], bytes(r["shingles"])) for r in found) == [(r, bytes([r % 251])) for r in expected]
    assert near.among(sets, rows.limit(0)).count() == 0


def test_workers_give_back_what_they_freed():
    def own() -> int:
        with open("/proc/self/smaps_rollup") as file:
            return next(int(line.split()[1]) for line in file if line.startswith("Pss_Anon"))

    pieces = [bytearray(1000) for _ in range(200_000)]
    kept = pieces[::500]  # these keep the memory between them from going back by itself
    del pieces
    before = own()
    common.give_back()
    assert own() < before - 100_000 and len(kept) == 400


def test_workers_empty_the_stores_of_other_operators():
    def filled() -> int:
        return toxicity._features.cache_info().currsize + len(substrings._hashes)

    common.let_go("toxicity")
    toxicity.counted({"some", "words"})
    substrings.gram_hashes([b"a", b"b", b"c"], 2)
    common.let_go("toxicity")
    assert filled() > 0  # tasks of one operator go on with what it has
    common.let_go("near")
    assert filled() == 0 and substrings._hashes.held == 0


def test_numbers_of_shingles():
    for values in ([], [7], [5, 5], np.random.default_rng(8).integers(0, 50, 300)):
        values = np.array(values, np.uint64)
        assert near.numbered(values).tolist() == np.unique(values, return_inverse=True)[1].tolist()


def test_stages_move_texts_in_small_parts(spark, documents, monkeypatch, tmp_path):
    names = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize", "parquet.block.size"]
    before = {n: spark.conf.get(n, None) for n in names}
    monkeypatch.setattr(session, "PART_BYTES", 50_000)
    frame = documents([(i, f"w{i} " * 500) for i in range(400)]).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    try:
        corpus_pipeline.STAGES[1][1](spark, frame, "").write.parquet(str(tmp_path / "out"))
        found = [r["n"] for r in frame.select("text").mapInArrow(sizes, "n long").collect()]
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert sum(found) == 400 and max(found) < 60
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
