"""Reports at an instant in mid-month, where newer rows must not count, against SQL."""

from __future__ import annotations

import re

import pytest
from harness import connect, difference
from pyspark.sql import functions as F

from postwarden.operators import metrics, pressure, trends
from postwarden.plans import fixtures as fx
from postwarden.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def middle():
    """An instant with events on both sides, at which a batch has just ended."""
    con = connect(SF)
    return str(con.execute("SELECT max(ts) FROM events GROUP BY event_id // 700 ORDER BY 1").fetchall()[0][0])


#: Reports at an instant.
REPORTS = {
    "system_metrics": lambda s, at: metrics.system_metrics(fx.metrics(s, SF), fx.predictions(s, SF), 120, at),
    "recent_activity": lambda s, at: metrics.recent_activity(fx.predictions(s, SF), 60, at),
    "fill_hours": lambda s, at: trends.fill_hours(fx.predictions(s, SF), 24, at),
    "hourly_trends": lambda s, at: trends.hourly_trends(fx.predictions(s, SF), 24, at),
    "cluster_pressure": lambda s, at: pressure.cluster_pressure(fx.memberships(s, SF), at),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_newer_rows_do_not_count(spark, middle, name):
    sql = re.sub(r"SELECT max\(ts\) AS as_of FROM events", f"SELECT TIMESTAMP '{middle}' AS as_of", ORACLES[name], count=1)
    assert sql != ORACLES[name]
    found = REPORTS[name](spark, middle)
    rounded = [(F.round(c, 6) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes]
    assert difference(found.select(*rounded), connect(SF), sql) is None


def test_metrics_have_samples_at_both_instants(spark, middle):
    for at in (middle, None):
        row = metrics.system_metrics(fx.metrics(spark, SF), fx.predictions(spark, SF), 120, at).first()
        assert row["samples"] >= 1 and row["error_rate"] > 0
        assert metrics.stats(fx.predictions(spark, SF), fx.memberships(spark, SF), fx.metrics(spark, SF), at).first()["error_rate"] > 0
