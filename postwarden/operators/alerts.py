"""Alerts made from fraudulent predictions."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import as_time, clamp01, minutes, non_empty, or_blank
from .records import UNTITLED, fraud_only

# Texts of alerts.
UPDATED_PREFIX = "UPDATED FRAUD DETECTION: "
NO_CORRECTION_REASON = "Fraud escalation detected: cluster risk threshold exceeded"
NO_CORRECTION_REASON_SHORT = "Fraud escalation detected"
NO_REASON = "Model flagged suspicious fraud pattern."
# Words that place a reason or title in a category, first hit wins.
ALERT_CATEGORIES = (
    (("domain",), "domain"),
    (("duplicate",), "duplicate"),
    (("salary",), "salary"),
    (("urgency", "pattern"), "pattern"),
    (("keyword",), "keyword"),
)
JOB_CATEGORIES = (
    (("remote",), "Remote"),
    (("engineer", "developer"), "Engineering"),
    (("analyst", "data"), "Data"),
    (("manager", "lead"), "Management"),
    (("designer",), "Design"),
)
AGE_LIMITS = {"5m": 5, "15m": 15, "1h": 60}


def latest_jobs(predictions: DataFrame, limit: int = 50) -> DataFrame:
    return predictions.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def fake_jobs(predictions: DataFrame, limit: int = 100) -> DataFrame:
    return latest_jobs(fraud_only(predictions), limit)


def alert_level(risk: Column, corrected: Column) -> Column:
    """critical, warning or info from the risk in per cent."""
    return (
        F.when(F.coalesce(corrected, F.lit(False)) | (risk >= 90), "critical")
        .when(risk >= 75, "warning")
        .otherwise("info")
    )


def alert_severity(confidence: Column, level: Column) -> Column:
    """The looser scale of the alert list."""
    return (
        F.when((confidence >= 0.9) | (level == "critical"), "critical")
        .when((confidence >= 0.7) | (level == "warning"), "warning")
        .otherwise("info")
    )


def alert_reason(
    corrected: Column,
    correction_reason: Column,
    reason: Column,
    missing: str = NO_CORRECTION_REASON,
) -> Column:
    why = F.coalesce(non_empty(correction_reason), non_empty(reason), F.lit(missing))
    return F.when(F.coalesce(corrected, F.lit(False)), F.concat(F.lit(UPDATED_PREFIX), why)).otherwise(
        F.coalesce(non_empty(reason), F.lit(NO_REASON))
    )


def _by_words(text: Column, table: Iterable[tuple[tuple[str, ...], str]], other: str) -> Column:
    body = F.lower(or_blank(text))
    found = []
    for words, name in table:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(body, F.lit(word))
        found.append(F.when(hit, name))
    return F.coalesce(*found, F.lit(other))


def alert_category(reason: Column) -> Column:
    return _by_words(reason, ALERT_CATEGORIES, "other")


def job_category(title: Column) -> Column:
    return _by_words(title, JOB_CATEGORIES, "General")


def score_status(score: Column, force: Column | None = None) -> Column:
    forced = F.lit(False) if force is None else F.coalesce(force, F.lit(False))
    return F.when(forced | (score >= 0.75), "FRAUD").otherwise("SAFE")


def _alert_rows(rows: DataFrame, score: Column, missing: str) -> DataFrame:
    """Shape rows as alerts from an unclamped score."""
    staged = rows.withColumn("_score", clamp01(score)).withColumn("_risk", F.round(F.col("_score") * 100, 2))
    return staged.select(
        F.coalesce(F.col("id").cast("string"), F.col("job_id"), F.lit("alert-unknown")).alias("id"),
        "job_id",
        F.coalesce(non_empty("title"), F.lit(UNTITLED)).alias("job_title"),
        F.col("_risk").alias("risk"),
        F.col("_score").alias("risk_score"),
        alert_reason(F.col("is_corrected"), F.col("correction_reason"), F.col("reason"), missing).alias("reason"),
        F.col("created_at").alias("timestamp"),
        alert_level(F.col("_risk"), F.col("is_corrected")).alias("level"),
        F.coalesce("is_corrected", F.lit(False)).alias("is_corrected"),
        "cluster_id",
        "correction_reason",
    )


def alerts(predictions: DataFrame, limit: int = 25) -> DataFrame:
    """The most risky fraudulent postings, the newest first among equals."""
    order = F.coalesce("updated_score", "original_score", "confidence")
    top = fraud_only(predictions).orderBy(F.desc(order), F.desc("created_at"), F.desc("id")).limit(limit)
    updated = F.coalesce("updated_score", "original_score", F.lit(0.0))
    score = F.when(updated > 0, updated).otherwise(F.coalesce("confidence", F.lit(0.0)))
    return _alert_rows(top, score, NO_CORRECTION_REASON)


def alert_from_prediction(predictions: DataFrame) -> DataFrame:
    """An alert per fraudulent prediction; for batches and streams."""
    score = F.coalesce("risk_score", "updated_score", "confidence", F.lit(0.0))
    return _alert_rows(fraud_only(predictions), score, NO_CORRECTION_REASON_SHORT)


def with_severity(rows: DataFrame) -> DataFrame:
    """Add the severity and category the list filters by."""
    return rows.withColumn("severity", alert_severity(F.col("risk_score"), F.col("level"))).withColumn(
        "category", alert_category(F.col("reason"))
    )


def alert_view(
    rows: DataFrame,
    as_of: Column | datetime | str,
    severity: str = "all",
    category: str = "all",
    age: str = "15m",
    sort: str = "risk-desc",
) -> DataFrame:
    """Alerts filtered by severity, category and age (5m, 15m, 1h, all) and sorted
    (risk-desc, risk-asc, newest)."""
    view = with_severity(rows)
    if severity != "all":
        view = view.filter(F.col("severity") == severity)
    if category != "all":
        view = view.filter(F.col("category") == category)
    if age != "all":
        now = as_time(as_of)
        view = view.filter(F.col("timestamp").between(now - minutes(AGE_LIMITS[age]), now))
    orders = {
        "risk-desc": F.desc("risk_score"),
        "risk-asc": F.asc("risk_score"),
        "newest": F.desc("timestamp"),
    }
    return view.orderBy(orders[sort], F.desc("timestamp"), F.desc("id"))


def critical_count(view: DataFrame) -> DataFrame:
    return view.filter(F.col("severity") == "critical").agg(F.count(F.lit(1)).alias("critical_alerts"))


def alert_categories(rows: DataFrame) -> DataFrame:
    return rows.select(alert_category(F.col("reason")).alias("category")).distinct()


def merge_alerts(existing: DataFrame, incoming: DataFrame, keep: int = 50) -> DataFrame:
    """Existing alerts overwritten by incoming ones with the same id; the newest stay.

    Latest by an aggregate, which combines before the shuffle, then a top-k.
    """
    columns = existing.columns
    both = existing.withColumn("_age", F.lit(0)).unionByName(
        incoming.select(*columns).withColumn("_age", F.lit(1))
    )
    latest = both.groupBy("id").agg(
        F.max_by(F.struct(*[c for c in columns if c != "id"]), F.struct("_age", "timestamp")).alias("row")
    )
    merged = latest.select("id", "row.*").select(*columns)
    return merged.orderBy(F.desc("timestamp"), F.desc("risk_score"), F.desc("id")).limit(keep)
