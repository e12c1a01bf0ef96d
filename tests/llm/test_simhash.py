"""SimHash near copies against brute force."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from postwarden.llm import simhash


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(bits, distance=4):
    parent = list(range(len(bits)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(bits))]


def check(rows, frame, **options):
    got = {(r["doc_id"], r["bits"] & (2**64 - 1)): r["component_id"] for r in simhash.near_copies(frame, **options).collect()}
    rows = sorted(rows)
    bits = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(bits)
    assert got == {(i, b): rows[r][0] for (i, _), b, r in zip(rows, bits, roots)}


def test_given_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in frame.collect()], frame)


def test_edges(spark, documents):
    rows = [(5, "A b C"), (2, "a B c"), (9, ""), (7, None), (1, "x " * 3000), (3, "long" * 5000), (4, "\t\n "), (6, "ä Ä ö Ö")]
    check(rows, documents(rows, {"bits": F.lit(1), "component_id": F.lit("x"), "part": F.lit(2)}))
    assert simhash.near_copies(documents([])).count() == 0


def test_repeated_rows_and_null_ids(documents):
    got = simhash.near_copies(documents([(1, "a b"), (1, "a b"), (1, "other words here"), (None, "a b"), (None, "q r s t u v")]))
    found = sorted((str(r["doc_id"]), str(r["component_id"])) for r in got.collect())
    assert found == [("1", "1"), ("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]


def flipped(rng, n, groups, spread):
    centres = [rng.getrandbits(64) for _ in range(groups)]
    return sorted({rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, spread))) for _ in range(n)})


def links_of(spark, values, **options):
    rows = [(int(np.uint64(v).view(np.int64)),) for v in values]
    links = simhash.link_fingerprints(spark.createDataFrame(rows, "bits long"), **options)
    return [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in links.collect()]


def same_classes(values, links):
    at = {v: i for i, v in enumerate(values)}
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        assert (a ^ b).bit_count() <= 4
        x, y = root(at[a]), root(at[b])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(values))] == brute_components(values)


def test_no_link_is_lost_in_any_split(spark):
    rng = random.Random(3)
    values = flipped(rng, 700, 12, 7)
    same_classes(values, links_of(spark, values))
    same_classes(values, links_of(spark, values, cell_rows=16))


def test_every_plan_covers_the_distance():
    rng = np.random.default_rng(1)
    blocks = [list(range(8 * i, 8 * i + 8)) for i in range(8)]
    for n in (10, 10**5, 10**9, 10**12):
        histograms = rng.integers(0, 50, (8, 256))
        histograms[0] = 0
        histograms[0, 3] = histograms.sum() // 8
        parts = simhash.plan_parts(blocks, histograms, n)
        used = sum(p.threshold + 1 for p in parts)
        assert used == simhash.DISTANCE + 1 and all(p.threshold >= 0 for p in parts)


def test_pair_distances_are_exact():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 256, 60)
    counts = np.bincount([(int(a) ^ int(b)).bit_count() for a in values for b in values], minlength=9)
    assert np.allclose(simhash.pair_distances(np.bincount(values, minlength=256)), counts / counts.sum())


def test_stage_keeps_one_of_each_group(spark, documents):
    rows = [(1, "one two three"), (4, "one two three"), (4, "one two three"), (2, "four five six seven"), (2, "four five six seven"), (None, "one two three"), (8, None)]
    frame = documents(rows, {"near_id": F.lit(0)})
    got = simhash.keep_first(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == [
        ("1", "one two three"), ("2", "four five six seven"), ("8", "None"), ("None", "one two three")
    ]
