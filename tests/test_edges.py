"""Edge rows of the rules, scores, times and small tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postwarden import schemas
from postwarden.config import Config
from postwarden.functions.scalars import parse_time, safe_bool, safe_double, safe_int
from postwarden.operators import alerts, anomaly, features, health, insights, metrics, pressure, records, replay, retry, rules, trends

POSTING = "job_id string, title string, description string, company string"


def reasons(spark, rows):
    df = features.combined_text(spark.createDataFrame(rows, POSTING))
    return {r["job_id"]: r["reason"] for r in rules.posting_reason(df).collect()}


def test_reason_rules(spark):
    long = "x" * 40
    got = reasons(
        spark,
        [
            ("blank company", "t", long, "  "),
            ("39", "t", "x" * 39, "c"),
            ("40", "t", long, "c"),
            ("two lines", "t", "a\nb", "c"),
            ("empty", "t", "", "c"),
            ("word", "t", "an urgent matter of some length, more than forty", "c"),
            ("inside word", "t", "urgently needed, a text of more than forty characters", "c"),
        ],
    )
    assert got == {
        "blank company": rules.MISSING_COMPANY,
        "39": rules.LOW_DETAIL,
        "40": rules.NORMAL_PATTERN,
        "two lines": rules.NORMAL_PATTERN,
        "empty": rules.LOW_DETAIL,
        "word": rules.SUSPICIOUS_LANGUAGE,
        "inside word": rules.NORMAL_PATTERN,
    }


def test_keywords_and_domains(spark):
    df = spark.createDataFrame(
        [("Urgently needed, CRYPTO", "x"), ("mail a@hotmail.com or b@gmail.com", "x"), ("see https://a.b/c", "x"), ("", "Proton.me")],
        "text string, company string",
    )
    rows = df.select(rules.keyword_hits("text").alias("h"), rules.domain_pattern("company", "text").alias("d")).collect()
    assert rows[0]["h"] == ["urgent", "crypto"] and rows[0]["d"] is None
    assert rows[1]["d"] == "free_email_domain:gmail.com"
    assert rows[2]["d"] == "contains_external_url"
    assert rows[3]["h"] == [] and rows[3]["d"] == "free_email_domain:proton.me"


@pytest.mark.parametrize(
    "prediction,confidence,expected",
    [(1, 0.8, 0.8), (0, 0.8, 0.2), (0, None, 1.0), (1, float("nan"), 0.0), (1, 1.2, 1.0), (0, 0.0, 1.0), (None, 0.3, 0.7)],
)
def test_base_score(spark, prediction, confidence, expected):
    df = spark.createDataFrame([(prediction, confidence)], "prediction int, confidence double")
    assert df.select(rules.base_score().alias("s")).first()["s"] == pytest.approx(expected)


def test_keyword_bonus_is_capped(spark):
    text = " ".join(("urgent", "telegram", "whatsapp", "wire transfer", "crypto", "no experience"))
    df = spark.createDataFrame(
        [("a", "t", text, "c", text, 1, 0.1, "", True, "r")],
        POSTING + ", combined_text string, prediction int, confidence double, event_timestamp string, "
        "batch_is_anomaly boolean, batch_anomaly_reason string",
    )
    row = rules.scored_record(df).first()
    assert row["risk_score"] == pytest.approx(0.1 + 0.25 + 0.15)
    assert row["reason_tags"][-1] == "batch_anomaly:r" and len(row["reason_tags"]) == 8


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2024-01-01T10:00:00Z", datetime(2024, 1, 1, 10)),
        ("2024-01-01T10:00:00+02:00", datetime(2024, 1, 1, 8)),
        (" 2024-01-01 10:00:00.5 ", datetime(2024, 1, 1, 10, 0, 0, 500000)),
        ("2024-01-01", datetime(2024, 1, 1)),
        ("2024-13-01", None),
        ("nope", None),
        ("", None),
        (None, None),
        ("12:30", None),
    ],
)
def test_parse_time(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_time("t").cast("timestamp_ntz").alias("p")).first()["p"] == expected


def test_safe_casts(spark):
    df = spark.createDataFrame([("1.9",), ("x",), (None,), ("NaN",), (" Yes ",), ("off",)], "v string")
    rows = df.select(safe_int("v", 7).alias("i"), safe_double("v", 0.5).alias("d"), safe_bool("v", True).alias("b")).collect()
    assert [r["i"] for r in rows] == [1, 7, 7, 7, 7, 7]
    assert [r["d"] for r in rows] == [1.9, 0.5, 0.5, 0.5, 0.5, 0.5]
    assert [r["b"] for r in rows] == [True, True, True, True, True, False]


def test_blank_alias_wins(spark):
    from postwarden.sources.postings import normalize_posting

    df = spark.createDataFrame([("", "7", " t ", "  ", "later")], "id string, job_id string, title string, description string, requirements string")
    row = normalize_posting(df, "now").first()
    assert (row["id"], row["title"], row["description"], row["timestamp"]) == ("7", "t", "", "now")
    twice = normalize_posting(df.drop("id", "job_id"), "now")
    assert twice.first()["id"] == twice.first()["id"]


def test_jsonl_skips_what_is_no_object(spark, tmp_path):
    from postwarden.sources.postings import read_postings_jsonl

    (tmp_path / "a.jsonl").write_text('{"id": 5, "title": "a", "company": null}\n\n[1]\nbroken\n{"title": ""}\n')
    rows = read_postings_jsonl(spark, str(tmp_path), "now").collect()
    assert [(r["id"], r["title"], r["company"]) for r in rows] == [("5", "a", "")]


def test_training_csv_missing(spark, tmp_path):
    from postwarden.sources.postings import read_training_csv

    assert read_training_csv(spark, str(tmp_path / "absent.csv")) is None


def test_medians(spark):
    df = spark.createDataFrame([(1.0, None, 5), (2.0, None, 5), (10.0, None, None), (None, None, 6)], "a double, b double, c bigint")
    rows = {r["name"]: r["median"] for r in features.exact_medians(df, ["a", "b", "c"]).collect()}
    assert rows == {"a": 2.0, "c": 5.0}
    filled = features.impute_median(df)
    assert filled.filter("b <> 0").count() == 0 and filled.filter("a IS NULL OR c IS NULL").count() == 0


def test_medians_with_many_values_and_a_hot_one(spark):
    df = spark.range(200_001).selectExpr("cast(if(id % 3 = 0, 7, (id * 7919) % 100003) as double) AS v")
    exact = df.agg(F.median("v")).first()[0]
    assert features.exact_medians(df, ["v"]).first()["median"] == exact


NOW = "2024-01-02 00:00:00"


def test_pressure_bounds(spark):
    rows = [("c", "1", "2024-01-01 00:00:00"), ("c", "2", "2024-01-01 00:00:01"), ("c", "3", "2024-01-01 23:00:00"), ("d", "4", "2024-01-01 12:00:00")]
    members = spark.createDataFrame(rows, "cluster_id string, job_id string, t string").selectExpr("cluster_id", "job_id", "cast(t AS timestamp_ntz) AS created_at")
    got = {r["cluster_id"]: (r["count_1h"], r["count_6h"], r["count_24h"]) for r in pressure.cluster_pressure(members, NOW).collect()}
    # members exactly 1 h or 24 h old do not count
    assert got == {"c": (0, 1, 2), "d": (0, 0, 1)}


@pytest.mark.parametrize("n,flips", [(1, False), (6, False), (7, True)])
def test_correction_by_cluster_size(spark, n, flips):
    rows = [(f"j{i}", 0, 0.6, 0.4, 0.4, 1, False, None, "r") for i in range(n)]
    df = spark.createDataFrame(
        rows,
        "job_id string, prediction int, confidence double, original_score double, updated_score double, version int, "
        "is_corrected boolean, correction_reason string, reason string",
    ).selectExpr("*", "'c' AS cluster_id", "timestamp_ntz'2024-01-01 12:00:00' AS created_at")
    members = df.select("cluster_id", "job_id", "created_at")
    out = pressure.apply_corrections(df, members, NOW).collect()
    assert len(out) == n
    assert {r["prediction"] for r in out} == {1 if flips else 0}
    assert {r["correction_type"] for r in out} == {"UPGRADE_TO_FRAUD" if flips else "RISK_INCREASE"}
    again = pressure.apply_corrections(
        pressure.latest_versions(df, pressure.apply_corrections(df, members, NOW)), members, NOW
    )
    assert again.count() == 0


def test_surge_marks(spark):
    rows = [(8, 0.9, None, None), (8, 0.1, 1.0, 0.1), (7, 0.1, 1.0, 0.1), (2, 0.55, 1.0, 0.1), (1, 1.0, 1.0, 0.1), (30, 0.9, 10.0, 0.4)]
    frame = spark.createDataFrame(rows, "fraud_jobs bigint, fraud_rate double, prior_count double, prior_rate double")
    flag, text = anomaly.surge_marks()
    assert [tuple(r) for r in frame.select(flag, text).collect()] == [
        (False, anomaly.WARMUP),
        (True, "fraud_count_spike:8>=8.00"),
        (False, anomaly.NORMAL),
        (True, "fraud_rate_spike:0.550>=0.550"),
        (False, anomaly.NORMAL),
        (True, "fraud_count_spike:30>=22.00; fraud_rate_spike:0.900>=0.720"),
    ]


@pytest.mark.parametrize("alpha", [0.01, 0.2, 0.9, 2.0])
def test_means_over_many_slices(spark, alpha):
    config = Config(ema_alpha=alpha)
    figures = {name: [(i * 7919) % 101 for i in range(n)] for name, n in (("a", 1500), ("b", 1), ("c", 40))}
    rows = [(k, i, x, x / 101) for k, xs in figures.items() for i, x in enumerate(xs)]
    stats = spark.createDataFrame(rows, "stream string, window_start int, fraud_jobs bigint, fraud_rate double")
    got = {(r["stream"], r["window_start"]): (r["ema_count"], r["ema_rate"]) for r in anomaly.ema_anomaly(stats, config=config).collect()}
    a = anomaly.smoothing(config)
    for name, xs in figures.items():
        mean = None
        for i, x in enumerate(xs):
            mean = float(x) if mean is None else a * x + (1 - a) * mean
            assert got[name, i] == pytest.approx((mean, mean / 101), rel=1e-9, abs=1e-12)


QUEUE = "job_id string, queued_at timestamp_ntz, attempts int, next_retry_at timestamp_ntz, failure_stage string, failure_reason string"


def test_last_attempt_is_dead(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", at, 6, at, "", ""), ("b", at, 7, at, "", "")], QUEUE)
    waiting, dead = retry.retry_plan(df, NOW)
    assert [(r["job_id"], r["attempts"], r["next_retry_at"]) for r in waiting.collect()] == [("a", 7, datetime(2024, 1, 2, 0, 1))]
    row = dead.first()
    assert (row["job_id"], row["retry_count"], row["failure_stage"], row["failure_reason"]) == ("b", 8, "db_retry", "max_retries_exceeded")


def test_backlog_at_capacity(spark):
    rows = [(str(i), datetime(2024, 1, 1, 0, i), 0, datetime(2024, 1, 1), "", "") for i in range(5)]
    df = spark.createDataFrame(rows, QUEUE)
    stays, dead = retry.cap_backlog(df, 5)
    assert (stays.count(), dead.count()) == (5, 0)
    stays, dead = retry.cap_backlog(df, 3)
    assert sorted(r["job_id"] for r in dead.collect()) == ["0", "1"] and stays.count() == 3


def test_replay_with_rate(spark):
    rows = [(i, t) for i, t in enumerate(("2024-01-01T00:00:00Z", "bad", "2024-01-01T00:00:04Z", "2024-01-01T00:00:03Z"))]
    df = spark.createDataFrame(rows, "n int, timestamp string")
    out = replay.replay_schedule(df, "n", speed=2.0, max_delay=1.5, rate=2.0).orderBy("n").collect()
    assert [r["delay_s"] for r in out] == [0.0, 0.0, 1.5, 0.0]
    assert [r["release_s"] for r in out] == [0.0, 0.5, 2.0, 2.5]


def test_recovery(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [(at(0), True), (at(5), False), (at(10), True), (at(40), True), (at(41), True)]
    df = spark.createDataFrame(rows, "sample_at timestamp_ntz, kafka_running boolean").selectExpr(
        "*", "true AS db_connected", "true AS ml_loaded", "0 AS recent_jobs", "0 AS kafka_lag"
    )
    out = health.system_mode(health.health_status(df)).orderBy("sample_at").collect()
    assert [r["mode"] for r in out] == ["normal", "degraded", "recovery", "recovery", "normal"]


def empty(spark, schema=schemas.PREDICTION):
    return spark.createDataFrame([], schema)


def test_empty_tables(spark):
    none, members, fixes = empty(spark), empty(spark, schemas.MEMBERSHIP), empty(spark, schemas.CORRECTION)
    board = metrics.dashboard_metrics(none, members, NOW).first()
    assert (board["total_jobs"], board["fake_percentage"], board["high_pressure_clusters"]) == (0, 0.0, 0)
    figures = empty(spark, schemas.extend(schemas.BATCH_METRIC, "created_at timestamp_ntz"))
    assert metrics.system_metrics(figures, none, 5, NOW).first()["samples"] == 0
    assert trends.hourly_trends(none, 24, NOW).agg(F.sum("total_jobs")).first()[0] == 0
    assert trends.cluster_spikes(members, fixes, 2, NOW).count() == 3
    assert insights.top_clusters(members, none, 8, NOW).count() == 0
    assert insights.corrections_with_jobs(fixes, none).count() == 0
    shown = alerts.alert_from_prediction(none)
    assert insights.alert_intelligence(shown, F.lit(0.5)).first()["highest_fraud_category"] == insights.NO_CATEGORY
    assert insights.confidence_histogram(shown).count() == 10
    assert pressure.cluster_pressure(members, NOW).count() == 0
    assert trends.metric_delta(trends.hourly_trends(none, 1, NOW).limit(0), "total_jobs").first()["delta"] == 0.0
    offsets = spark.createDataFrame([], "partition int, end_offset bigint, committed bigint")
    assert metrics.group_lag(offsets).first()["lag"] == 0
    assert metrics.group_lag(spark.createDataFrame([(0, 5, None)], offsets.schema)).first()["lag"] is None
    assert records.serve_prediction(none).count() == 0


def test_truth_table_of_evaluate(spark):
    from postwarden.operators.model import evaluate

    df = spark.createDataFrame([(0, 0), (0, 0)], "fraudulent int, prediction int")
    row = evaluate(df).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_retry_pass_loses_no_row_that_shares_a_job(spark):
    at = datetime(2024, 1, 1)
    late = datetime(2024, 1, 9)
    rows = [("a", at, 1, at), ("a", at, 2, late), ("b", at, 3, at), ("b", late, 3, late), ("a", late, 1, at)]
    queue = spark.createDataFrame(
        [(j, "t", 0.5, q, n, d, "db_insert", "x") for j, q, n, d in rows],
        "job_id string, title string, confidence double, queued_at timestamp_ntz, attempts int, "
        "next_retry_at timestamp_ntz, failure_stage string, failure_reason string",
    )
    out = retry.retry_pass(queue, lambda due: (due.filter("job_id = 'a'"), due.filter("job_id = 'b'")), datetime(2024, 1, 2))
    assert [out[k].count() for k in ("stored", "queue", "dead")] == [2, 3, 0]


def test_reports_leave_out_rows_after_their_instant(spark):
    day = lambda d, h=0: datetime(2024, 1, d, h)
    members = spark.createDataFrame(
        [("c", f"j{i}", t) for i, t in enumerate((day(9, 23), day(10), day(15)))], "cluster_id string, job_id string, created_at timestamp_ntz"
    )
    got = pressure.cluster_pressure(members, "2024-01-10 00:00:00").first()
    assert (got["count_1h"], got["count_24h"]) == (1, 2)
    rows = members.withColumns({"prediction": F.lit(1), "id": F.lit(1)})
    assert metrics.recent_activity(rows, 120, "2024-01-10 00:00:00").first()["recent_jobs"] == 2
    assert sum(r["total"] for r in trends.fill_hours(rows, 24, "2024-01-10 00:00:00").collect()) == 2
