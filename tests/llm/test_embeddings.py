"""Lattice hashing against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwarden.llm import embeddings
from postwarden.llm.queries import QUERIES


def brute(rows, cosine=0.95):
    """rows: (vec_id, list or None) -> sorted (vec_id, n_links, component_id, kept)"""
    unit = []
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v else np.array([np.nan])
        good = i is not None and np.isfinite(x).all() and x.any()
        unit.append(x / np.linalg.norm(x) if good else None)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    lowest = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            lowest[root(i)] = min(vec_id, lowest.get(root(i), vec_id))
    return sorted((str(v), links[i], str(lowest.get(root(i))), v is None or v == lowest[root(i)]) for i, (v, _) in enumerate(rows))


def got(frame, **options):
    rows = embeddings.near_vectors(frame, **options).collect()
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in rows)


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id long, embedding array<float>, label int")


def clustered(rng, n, dimension=64):
    centres = rng.normal(size=(12, dimension))
    out = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dimension) * rng.choice([0.02, 0.1, 0.22, 3.0])
        out.append((int(i * 3), np.float32(v).tolist()))
    return out + [(i + 1, v) for i, v in out[: n // 6]]


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 8)) * 2
    found = embeddings.decode(x)
    doubled = np.rint(2 * found).astype(int)
    assert ((doubled % 2 == doubled[:, :1] % 2).all()) and (doubled.sum(axis=1) % 4 == 0).all()
    around = embeddings.minimal_vectors()
    assert len(around) == 240 and np.allclose((around**2).sum(axis=1), 2)
    best = ((x - found) ** 2).sum(axis=1)
    assert (best[:, None] <= ((x[:, None] - found[:, None] - around[None]) ** 2).sum(axis=2) + 1e-9).all()
    assert best.max() <= 1 + 1e-9  # the covering radius


@pytest.mark.parametrize("lattices", [1, 2, 3])
def test_recall_at_the_threshold(lattices):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = embeddings.cells(x, lattices), embeddings.cells(y, lattices)
    met = (b == a[:, :, :1]).any(axis=2) | (a == b[:, :, :1]).any(axis=2)
    assert met.any(axis=1).mean() >= 0.98


def test_links_equal_brute_force(spark):
    rows = clustered(np.random.default_rng(14), 500)
    want, found = brute(rows), got(frame_of(spark, rows))
    assert sum(r[1] for r in found) >= 0.98 * sum(r[1] for r in want)
    assert all(f[1] <= w[1] for f, w in zip(found, want))
    # slices of cells change nothing
    assert got(frame_of(spark, rows), slice_rows=20) == found


@pytest.mark.parametrize("lattices", [1, 2])
def test_each_pair_counts_once(spark, lattices, monkeypatch):
    monkeypatch.setattr(embeddings, "ONE_UP_TO", 0 if lattices == 2 else 10**6)
    rng = np.random.default_rng(15)
    rows = [(i, np.float32(np.ones(16) + rng.normal(size=16) * 0.01).tolist()) for i in range(60)]
    assert got(frame_of(spark, rows), slice_rows=9) == brute(rows)


def test_edges(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]),
        (9, one), (8, one), (8, one), (None, one), (7, [2.0, 4.0, 6.0]), (10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [1e-30, 2e-30, 3e-30]),
        (13, [-1.0, -2.0, -3.0]), (13, [5.0, -9.0, 1.0]),
    ]
    frame = frame_of(spark, rows).withColumn("rep", F.lit(1)).withColumn("n_links", F.lit("x"))
    assert got(frame) == brute(rows)
    assert got(frame.limit(0)) == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = QUERIES["op2_embeddings"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in found) == brute(rows)


def test_links_do_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    used = []
    plain = embeddings.linked_vectors
    monkeypatch.setattr(embeddings, "linked_vectors", lambda d, lattices, *a: used.append(lattices) or plain(d, lattices, *a))
    rows = [(i, [float(i % 7), 1.0, float(i % 3)] * 4) for i in range(30)]
    before = got(frame_of(spark, rows))
    monkeypatch.setattr(embeddings, "ONE_UP_TO", 0)
    assert got(frame_of(spark, rows)) == before and len(set(used)) == 1
