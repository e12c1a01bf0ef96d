"""The layout helpers, clusters and corrections against one-by-one computations, with
hot keys and thresholds small enough that every split path runs."""

from __future__ import annotations

import math
import random
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from postwarden.config import DEFAULT
from postwarden.functions.layout import global_order, sliced_running_sum, split_join
from postwarden.operators import pressure, similarity
from postwarden.operators.vectors import tfidf_weights

HOT = replace(DEFAULT, hot_key_rows=7, slice_rows=5)
START = datetime(2024, 1, 1)


def test_global_order_with_one_hot_time(spark):
    rows = [(i, 5 if i % 3 else i) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, t int").repartition(7)
    got = [(r["id"], r["rank"]) for r in global_order(df, ["t", "id"]).collect()]
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert dict(got) == want


def test_running_sums(spark):
    rng = random.Random(1)
    rows = {}
    for _ in range(3000):
        rows[(rng.choice("aaaab"), START + timedelta(seconds=rng.randrange(200_000)))] = rng.randrange(-5, 6)
    df = spark.createDataFrame([(k, t, v) for (k, t), v in rows.items()], "k string, t timestamp_ntz, v bigint")
    got = {(r["k"], r["t"]): r["v"] for r in sliced_running_sum(df, "k", "t", ["v"], 5).collect()}
    sums, want = {}, {}
    for (k, t), v in sorted(rows.items()):
        sums[k] = sums.get(k, 0) + v
        want[(k, t)] = sums[k]
    assert got == want


def test_split_join_equals_plain_join(spark):
    left = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 0, id % 50) AS k")
    right = spark.range(40).selectExpr("id AS k", "id * 2 AS v")
    for how in ("inner", "left"):
        got = sorted(map(str, split_join(left, right, ["k"], how, 20).select("id", "k", "v").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("id", "k", "v").collect()))


def members(spark, rows):
    return spark.createDataFrame(rows, "cluster_id string, job_id string, created_at timestamp_ntz")


def cluster_rows(n=400, seed=3):
    rng = random.Random(seed)
    times = sorted(rng.randrange(0, 5 * 86400) for _ in range(n))
    # one cluster holds most rows, some times repeat
    return [(rng.choice(["hot", "hot", "hot", "a", "b"]), f"j{i:04d}", START + timedelta(seconds=t - t % 60)) for i, t in enumerate(times)]


def test_pressure_at_insert_by_hand(spark):
    rows = cluster_rows()
    got = {r["job_id"]: (r["count_1h"], r["count_6h"], r["count_24h"]) for r in pressure.pressure_at_insert(members(spark, rows), HOT).collect()}
    for c, j, t in rows:
        want = tuple(sum(1 for d, _, u in rows if d == c and u <= t and t - u < timedelta(hours=h)) for h in (1, 6, 24))
        assert got[j] == want


def test_history_equals_one_by_one_inserts(spark):
    rng = random.Random(5)
    rows = cluster_rows(250)
    scores = {j: (rng.choice([0, 0, 1]), round(rng.random(), 3)) for _, j, _ in rows}
    df = spark.createDataFrame(
        [(j, c, t, scores[j][0], scores[j][1], scores[j][1], False) for c, j, t in rows],
        "job_id string, cluster_id string, created_at timestamp_ntz, prediction int, original_score double, "
        "updated_score double, is_corrected boolean",
    ).withColumn("confidence", F.lit(0.5))
    got = sorted(
        (r["updated_at"], r["job_id"], round(r["old_score"], 9), round(r["new_score"], 9), r["correction_type"])
        for r in pressure.correction_history(df, members(spark, rows), HOT).collect()
    )
    state = {j: [p, s, s, False] for j, (p, s) in scores.items()}
    want = []
    for c in {c for c, _, _ in rows}:
        mine = [(j, t) for d, j, t in rows if d == c]
        for now in sorted({t for _, t in mine}):
            force = math.log(sum(1 for _, t in mine if t <= now and now - t < timedelta(hours=24)) + 1)
            for j, t in mine:
                if t > now:
                    continue
                seen, base, last, done = state[j]
                new = min(1.0, base + 0.5 * force)
                if new - base <= 0.3:
                    continue
                nxt = 1 if force > 2 else seen
                if done and abs(new - last) < 1e-9 and nxt == seen:
                    continue
                want.append((now, j, round(last, 9), round(new, 9), "UPGRADE_TO_FRAUD" if nxt != seen else "RISK_INCREASE"))
                state[j] = [nxt, base, new, True]
    assert got == sorted(want)


def postings(spark, n=120):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(6)]
    rows = []
    for i in range(n):
        # a third are copies of one text, others vary a little
        text = base[0] if i % 3 == 0 else " ".join([*rng.choice(base).split()[:10], rng.choice(words), rng.choice(words)])
        rows.append((f"j{i:03d}", "" if i == 50 else text, START + timedelta(minutes=11 * i)))
    rows.append(("j999", base[1], START + timedelta(days=3)))
    return rows, spark.createDataFrame(rows, "job_id string, combined_text string, created_at timestamp_ntz")


def brute_force(rows, weights, reach, hours, threshold):
    names = [r[0] for r in rows]
    terms = sorted({t for w in weights.values() for t in w})
    dense = np.array([[weights.get(n, {}).get(t, 0.0) for t in terms] for n in names])
    out = {}
    for i, (name, text, at) in enumerate(rows):
        if not text:
            continue
        best = None
        for k in range(i - 1, max(-1, i - 1 - reach), -1):
            if rows[k][1] and at - rows[k][2] <= timedelta(hours=hours):
                s = round(float(dense[i] @ dense[k]), 9)
                if s >= threshold and (best is None or s > best[1]):
                    best = (names[k], s)
        if best:
            out[name] = best
    return out


def test_matches_and_clusters_by_hand(spark):
    rows, df = postings(spark)
    weights: dict[str, dict[str, float]] = {}
    for r in tfidf_weights(df).collect():
        weights.setdefault(r["job_id"], {})[r["term"]] = r["weight"]
    config = HOT
    want = brute_force(rows, weights, len(rows), 24, 0.8)
    got = {r["job_id"]: (r["match_job_id"], r["similarity"]) for r in similarity.similar_prior_postings(df, config).collect()}
    assert got == want and len(want) > 50
    clusters = {r["job_id"]: r["cluster_id"] for r in similarity.assign_clusters(df, config).collect()}
    assert len(clusters) == len(rows) and clusters["j050"] == "cluster_0"
    for name, _, _ in rows:
        if name in want:
            assert clusters[name] == clusters[want[name][0]]


def test_a_match_far_back_counts_until_the_window_ends(spark):
    rows = [("first", "rare words of one text", START), ("copy", "rare words of one text", START + timedelta(hours=24))]
    rows += [(f"n{i:03d}", f"filler {i} number {i * 7} again", START + timedelta(minutes=1 + i)) for i in range(700)]
    rows += [("late", "rare words of one text again", START + timedelta(hours=23)), ("gone", "filler 3 number 21 again", START + timedelta(hours=25))]
    df = spark.createDataFrame(rows, "job_id string, combined_text string, created_at timestamp_ntz")
    got = {r["job_id"]: r["match_job_id"] for r in similarity.similar_prior_postings(df).collect()}
    assert got["copy"] == "first" and got["late"] == "first" and got.get("gone") != "n003"


def test_vectors_travel_by_slices_not_by_pairs(spark):
    # 300 unlike texts that share most words: nearly every pair is worth a look
    rows = [(f"j{i:03d}", " ".join(f"w{k}" for k in range(40) if k != i % 40) + f" x{i}", i) for i in range(300)]
    rows.append(("j900", rows[0][1], 10**9))
    df = spark.createDataFrame(rows, "job_id string, combined_text string, us long")
    held = similarity.weighted_vectors(tfidf_weights(df)).localCheckpoint()
    placed = held.join(df, "job_id").select("job_id", "us", F.lit(True).alias("asks"), "v")
    vectors = held.drop("job_id").dropDuplicates(["v"])
    lengths = vectors.select("v", F.size("terms").alias("n_terms"))
    assert similarity.blocks(placed, lengths, 10**6).count() <= 2 * 300 + 2
    dense = {r["v"]: dict(zip(r["terms"], r["weights"])) for r in vectors.collect()}
    product = lambda a, b: round(sum(w * dense[b].get(t, 0.0) for t, w in dense[a].items()), 9)
    early = {r["v"] for r in placed.filter("us < 1000").collect()}
    want = {(a, b) for a in early for b in early if a != b and product(a, b) >= 0.5}
    for slice_terms in (10**6, 2000):
        found = similarity.vector_links(placed, vectors, 10**6, 0.5, slice_terms).collect()
        got = {(r["v"], r["other"]): r["similarity"] for r in found}
        # links are cut by the first and last times of a slot alone
        times = {r["v"]: r["us"] for r in placed.filter("us < 1000").collect()}
        assert set(got) == {(a, b) for a, b in want if times[b] <= times[a]} and len(got) > 1000
        assert all(abs(s - product(a, b)) < 2e-9 for (a, b), s in got.items())


def test_supplied_ids_and_candidates_only(spark):
    df = spark.createDataFrame(
        [
            ("a", "same words here", START, "given", False),
            ("b", "same words here", START + timedelta(minutes=1), None, True),
            ("c", "quite other text", START + timedelta(minutes=2), "mine", True),
        ],
        "job_id string, combined_text string, created_at timestamp_ntz, cluster_id string, asks boolean",
    )
    got = {r["job_id"]: r["cluster_id"] for r in similarity.assign_clusters(df).collect()}
    assert got == {"a": "given", "b": "given", "c": "mine"}


def test_long_chain_resolves(spark):
    links = spark.range(300).selectExpr("cast(id + 1 AS string) AS job_id", "cast(id AS string) AS parent_id")
    roots = similarity.resolve_roots(links, HOT)
    assert roots.count() == 300 and roots.filter("root_id <> '0'").count() == 0


def test_medians_of_a_million_distinct_values_in_slices(spark):
    from postwarden.operators.features import exact_medians

    df = spark.range(1_000_001).select(
        ((F.col("id") * 7919) % 1_000_003).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") / 3).alias("b")
    )
    got = {r["name"]: r["median"] for r in exact_medians(df, ["a", "b"], slice_rows=50).collect()}
    want = {c: df.agg(F.expr(f"percentile({c}, 0.5)")).first()[0] for c in ("a", "b")}
    assert got == want
