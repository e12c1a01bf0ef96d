"""What the alerts, corrections and clusters have in common."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import STOP_WORDS
from ..functions.scalars import clamp01, clock, count_if, hours, non_blank, non_empty, or_blank
from .alerts import NO_CORRECTION_REASON, job_category
from .records import INCREASE, UNTITLED, UPGRADE

# Texts shown without data.
UNKNOWN_REASON = "Unknown reason"
NO_CATEGORY = "Insufficient data"
NO_ALERTS = "No alerts yet"
NO_SPIKE = "No keyword spike"


def corrections_with_jobs(corrections: DataFrame, predictions: DataFrame, limit: int = 50) -> DataFrame:
    """The newest corrections with title and cluster of their posting.

    Every correction survives the left join at least once, so the newest ``limit``
    corrections are taken before it and only they meet the predictions; a job id
    that occurs more than once fans out, and the limit is applied again.
    """
    newest = corrections.select(
        "job_id", "old_score", "new_score", "reason", "correction_type", "updated_at"
    ).orderBy(F.desc("updated_at"), "job_id").limit(limit)
    jobs = predictions.select("job_id", "title", "cluster_id")
    # at most ``limit`` rows, far below any broadcast bound
    wanted = F.broadcast(newest.select("job_id").distinct())
    found = jobs.join(wanted, "job_id", "left_semi")
    joined = newest.join(found, "job_id", "left").orderBy(F.desc("updated_at"), "job_id", "title").limit(limit)
    return joined.select(
        "job_id",
        F.coalesce(non_empty("title"), F.lit(UNTITLED)).alias("job_title"),
        "cluster_id",
        F.coalesce("old_score", F.lit(0.0)).alias("old_score"),
        F.coalesce("new_score", F.lit(0.0)).alias("new_score"),
        F.coalesce(non_empty("reason"), F.lit(NO_CORRECTION_REASON)).alias("reason"),
        F.coalesce(non_empty("correction_type"), F.lit(INCREASE)).alias("correction_type"),
        "updated_at",
    )


def recent_corrections(corrections: DataFrame, limit: int = 50) -> DataFrame:
    """The newest corrections; ``is_featured`` marks the newest upgrade, or the
    newest of all when there is none, among the first eight."""
    newest = corrections.orderBy(F.desc("updated_at"), "job_id").limit(limit)
    # at most ``limit`` rows
    order = Window.orderBy(F.desc("updated_at"), "job_id")
    shown = newest.withColumn("position", F.row_number().over(order))
    upgrade = F.when((F.col("position") <= 8) & (F.col("correction_type") == UPGRADE), F.col("position"))
    featured = F.coalesce(F.min(upgrade).over(Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(1))
    return shown.withColumn("is_featured", F.col("position") == featured)


def top_clusters(
    members: DataFrame,
    predictions: DataFrame,
    limit: int = 8,
    as_of: Column | datetime | str | None = None,
) -> DataFrame:
    """The clusters with the highest pressure over the last 24 hours."""
    now = clock(members, "created_at", as_of)
    recent = members.filter(F.col("created_at").between(now - hours(24), now)).select("cluster_id", "job_id", "created_at")
    jobs = predictions.select("job_id", "is_corrected", "updated_score")
    newer = lambda n: F.col("created_at") >= now - hours(n)
    joined = recent.join(jobs, "job_id", "left")
    ranked = joined.groupBy("cluster_id").agg(
        count_if(newer(1)).alias("jobs_1h"),
        count_if(newer(6)).alias("jobs_6h"),
        F.count(F.lit(1)).alias("jobs_24h"),
        F.log(F.count(F.lit(1)) + F.lit(1.0)).alias("pressure_score"),
        count_if(F.coalesce("is_corrected", F.lit(False))).alias("corrected_jobs"),
        F.coalesce(F.max("updated_score"), F.lit(0.0)).alias("peak_score"),
    )
    order = (F.desc("pressure_score"), F.desc("corrected_jobs"), F.desc("jobs_24h"), "cluster_id")
    return ranked.orderBy(*order).limit(limit).filter(or_blank("cluster_id") != "").orderBy(*order)


def cluster_heatmap(top: DataFrame, rows: int = 6) -> DataFrame:
    """Size, fraud and growth of the first clusters of the report, each from 0 to 1.
    The window spans the report only, ``rows`` rows."""
    shown = top.orderBy(F.desc("pressure_score"), F.desc("corrected_jobs"), F.desc("jobs_24h"), "cluster_id").limit(rows)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    largest = F.greatest(F.max("jobs_24h").over(everything), F.lit(1))
    growth = F.when(F.col("jobs_6h") > 0, F.col("jobs_1h") / F.col("jobs_6h")).otherwise(
        F.when(F.col("jobs_1h") > 0, 1.0).otherwise(0.0)
    )
    fixed = F.col("corrected_jobs") / F.greatest(F.col("jobs_24h"), F.lit(1))
    return shown.select(
        "*",
        (F.col("jobs_24h") / largest).alias("size_intensity"),
        F.greatest("peak_score", fixed).alias("fraud_intensity"),
        F.least(F.lit(1.0), growth * 2).alias("growth_intensity"),
        F.round(growth * 100).cast("int").alias("growth_percent"),
    )


def _reason() -> Column:
    return F.coalesce(non_blank("reason"), F.lit(UNKNOWN_REASON)).alias("reason")


def reason_distribution(alerts: DataFrame, k: int = 8) -> DataFrame:
    counts = alerts.groupBy(_reason()).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "reason").limit(k)


def _keyword_counts(alerts: DataFrame, text: Column) -> DataFrame:
    words = F.explode(F.split(F.lower(text), "[^a-z0-9]+")).alias("keyword")
    kept = alerts.select(words).filter((F.length("keyword") > 2) & ~F.col("keyword").isin(*STOP_WORDS))
    return kept.groupBy("keyword").agg(F.count(F.lit(1)).alias("count"))


def top_keywords(alerts: DataFrame, k: int = 8) -> DataFrame:
    """Most used words of titles and reasons, short and common ones left out."""
    text = F.concat_ws(" ", or_blank("job_title"), or_blank("reason"))
    return _keyword_counts(alerts, text).orderBy(F.desc("count"), "keyword").limit(k)


def confidence_histogram(alerts: DataFrame, value: str = "risk_score") -> DataFrame:
    """Ten equal bins over 0..1, all present; 1 falls in the last."""
    place = F.least(F.lit(9), F.floor(clamp01(F.coalesce(value, F.lit(0.0))) * 10)).cast("int")
    counts = alerts.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = alerts.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    # ten rows
    joined = bins.join(F.broadcast(counts), "bin", "left")
    return joined.select("bin", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def category_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(job_category(F.col("job_title")).alias("category")).agg(
        F.count(F.lit(1)).alias("count")
    )


def alert_intelligence(alerts: DataFrame, avg_confidence: Column) -> DataFrame:
    """The most frequent category, reason and keyword, one row; ties go to the first name."""

    def winner(counts: DataFrame, name: str) -> Column:
        best = F.min(F.struct(-F.col("count"), F.col(name)))
        return counts.agg(best).scalar()

    reasons = alerts.groupBy(_reason()).agg(F.count(F.lit(1)).alias("count"))
    category = winner(category_counts(alerts), "category").getField("category")
    reason = winner(reasons, "reason").getField("reason")
    keyword = winner(_keyword_counts(alerts, or_blank("reason")), "keyword")
    sure = F.round(clamp01(F.coalesce(avg_confidence, F.lit(0.0))) * 1000) / 10
    spike = F.concat(keyword.getField("keyword"), F.lit(" +"), (-keyword.getField("col1")).cast("string"))
    return alerts.sparkSession.range(1).select(
        F.coalesce(category, F.lit(NO_CATEGORY)).alias("highest_fraud_category"),
        F.coalesce(reason, F.lit(NO_ALERTS)).alias("common_fraud_reason"),
        F.coalesce(spike, F.lit(NO_SPIKE)).alias("suspicious_keyword_spike"),
        sure.alias("model_confidence"),
    )


def correction_event_summary(corrections: DataFrame, newest: int = 35, least: int = 3) -> DataFrame:
    """Clusters with several of the newest corrections: how many, and the latest."""
    recent = corrections.orderBy(F.desc("updated_at"), "job_id").limit(newest)
    groups = recent.filter(or_blank("cluster_id") != "").groupBy("cluster_id")
    return groups.agg(F.count(F.lit(1)).alias("count"), F.max("updated_at").alias("latest_at")).filter(
        F.col("count") >= least
    )


def live_fraud_feed(corrections: DataFrame, k: int = 20, newest: int = 35) -> DataFrame:
    """Messages about the newest corrections: each one, clusters with three or more,
    and the newest score of 0.9 or higher. Input: corrections_with_jobs.

    The three kinds come from one pass over the newest rows; the windows span
    these ``newest`` rows only.
    """
    recent = corrections.orderBy(F.desc("updated_at"), "job_id").limit(newest)
    clustered = or_blank("cluster_id") != ""
    place = Window.partitionBy("cluster_id").orderBy(F.desc("updated_at"), "job_id")
    high = F.col("new_score") >= 0.9
    order = Window.orderBy(F.desc("updated_at"), "job_id")
    marked = recent.withColumns(
        {
            "_n": F.count(F.lit(1)).over(Window.partitionBy("cluster_id")),
            "_first": clustered & (F.row_number().over(place) == 1),
            "_top": high & (F.sum(F.when(high, 1).otherwise(0)).over(order.rowsBetween(
                Window.unboundedPreceding, 0)) == 1),
        }
    )
    upgraded = F.col("correction_type") == UPGRADE
    stamp = F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    def event(kind: str, subject: str, message: Column, tone: Column) -> Column:
        name = F.concat(F.lit(f"event-{kind}-"), F.col(subject), F.lit("-"), stamp)
        return F.struct(name.alias("id"), message.alias("message"), tone.alias("tone"))

    upgrade_text = F.concat(
        F.lit("Job upgraded to FRAUD ("), F.coalesce("cluster_id", F.lit("cluster spike")), F.lit(")")
    )
    single = event(
        "job",
        "job_id",
        F.when(upgraded, upgrade_text).otherwise(F.concat(F.lit("Risk increase applied for "), "job_title")),
        F.when(upgraded, "critical").otherwise("warning"),
    )
    grouped = event(
        "cluster",
        "cluster_id",
        F.concat(F.col("_n").cast("string"), F.lit(" jobs corrected in "), "cluster_id"),
        F.lit("critical"),
    )
    pattern = event(
        "pattern",
        "job_id",
        F.concat(F.lit("High-risk pattern detected in "), F.coalesce("cluster_id", F.lit("active cluster"))),
        F.lit("warning"),
    )
    events = F.array_compact(
        F.array(single, F.when(F.col("_first") & (F.col("_n") >= 3), grouped), F.when(F.col("_top"), pattern))
    )
    feed = marked.select(F.col("updated_at").alias("timestamp"), F.explode(events).alias("event"))
    return feed.select("event.id", "timestamp", "event.message", "event.tone").orderBy(F.desc("timestamp"), "id").limit(k)
