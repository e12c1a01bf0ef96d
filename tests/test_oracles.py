"""Every query with a SQL twin against it, the others against their invariants."""

from __future__ import annotations

import os

import pytest
from harness import connect, difference

import __spark_entry__ as entry_points

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 25


def test_unit_length(spark):
    norms = [r["norm"] for r in QUERIES["fit_tfidf"](spark, SF).collect()]
    assert norms and all(abs(n - 1) < 1e-6 for n in norms)


def test_split_is_complete_and_stable(spark):
    first = {tuple(r) for r in QUERIES["train_test_split"](spark, SF).collect()}
    assert first == {tuple(r) for r in QUERIES["train_test_split"](spark, SF).collect()}
    assert len({job for job, _ in first}) == len(first)


def test_scores_are_probabilities(spark):
    rows = QUERIES["score"](spark, SF).collect()
    assert rows and all(r["prediction"] in (0, 1) and 0.5 - 1e-9 <= r["confidence"] <= 1 for r in rows)


def test_champion_has_the_higher_f1(spark):
    rows = QUERIES["train"](spark, SF).collect()
    best = max(r["f1"] for r in rows)
    assert [r["f1"] for r in rows if r["champion"]] == [best]


def test_snapshot_frames(spark):
    rows = QUERIES["snapshot"](spark, SF).collect()
    items = {f: len({r["item"] for r in rows if r["frame"] == f}) for f in {r["frame"] for r in rows}}
    assert items["metrics"] == 1 and items["trends"] == 25 and items["alerts"] == 25
