"""Hourly series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import clock, count_if, hour_start, hours, is_one
from .records import prediction_label


def hour_spine(df: DataFrame, now: Column, window_hours: int) -> DataFrame:
    """One row per hour of the window, ``window_hours`` + 1 of them."""
    one = df.sparkSession.range(1)
    hour = F.explode(F.sequence(hour_start(now - hours(window_hours)), hour_start(now), F.expr("INTERVAL 1 HOUR")))
    return one.select(hour.alias("bucket_start"))


def _hourly(df: DataFrame, time: str, now: Column, window_hours: int, *aggs: Column) -> DataFrame:
    recent = df.filter(F.col(time).between(now - hours(window_hours), now))
    return recent.groupBy(hour_start(time).alias("bucket_start")).agg(*aggs)


def fill_hours(
    df: DataFrame, window_hours: int = 24, as_of: Column | datetime | str | None = None, time: str = "created_at"
) -> DataFrame:
    """Rows per hour of the window, hours without rows as 0."""
    now = clock(df, time, as_of)
    # one row per hour of the report
    counts = F.broadcast(_hourly(df, time, now, window_hours, F.count(F.lit(1)).alias("total")))
    return hour_spine(df, now, window_hours).join(counts, "bucket_start", "left").select("bucket_start", _filled("total"))


def bucket_label(c: Column | str = "bucket_start") -> Column:
    return F.date_format(c, "HH:mm")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def hourly_trends(
    predictions: DataFrame, window_hours: int = 24, as_of: Column | datetime | str | None = None
) -> DataFrame:
    """Total, fake and real postings per hour, hours without postings included.

    The first hour is partial: rows count from exactly ``window_hours`` ago.
    """
    now = clock(predictions, "created_at", as_of)
    counts = _hourly(
        predictions,
        "created_at",
        now,
        window_hours,
        F.count(F.lit(1)).alias("total_jobs"),
        count_if(is_one("prediction")).alias("fake_jobs"),
    )
    # both sides have at most one row per hour of the window
    joined = hour_spine(predictions, now, window_hours).join(F.broadcast(counts), "bucket_start", "left")
    points = joined.select("bucket_start", _filled("total_jobs"), _filled("fake_jobs"))
    return points.select(
        bucket_label().alias("timestamp"),
        "bucket_start",
        "total_jobs",
        "fake_jobs",
        F.greatest(F.col("total_jobs") - F.col("fake_jobs"), F.lit(0)).alias("real_jobs"),
        F.round(F.col("total_jobs") / 3600, 3).alias("throughput"),
    ).orderBy("bucket_start")


def cluster_spikes(
    members: DataFrame,
    corrections: DataFrame,
    window_hours: int = 24,
    as_of: Column | datetime | str | None = None,
) -> DataFrame:
    """New cluster members and corrections per hour, with their sum as pressure."""
    now = clock(members, "created_at", as_of)
    number = F.count(F.lit(1))
    joined = F.broadcast(_hourly(members, "created_at", now, window_hours, number.alias("cluster_jobs")))
    fixed = F.broadcast(_hourly(corrections, "updated_at", now, window_hours, number.alias("corrections")))
    points = (
        hour_spine(members, now, window_hours)
        .join(joined, "bucket_start", "left")
        .join(fixed, "bucket_start", "left")
    )
    return points.select(
        bucket_label().alias("timestamp"), "bucket_start", _filled("cluster_jobs"), _filled("corrections")
    ).orderBy("bucket_start")


def spike_pressure(spikes: DataFrame) -> DataFrame:
    return spikes.withColumn("pressure", F.col("cluster_jobs") + F.col("corrections"))


def minute_of_day_trends(latest: DataFrame) -> DataFrame:
    """Postings per HH:MM over a page of the newest rows; days fall together."""
    rows = latest.filter(F.col("created_at").isNotNull())
    fake = prediction_label("prediction") == "FAKE"
    counts = rows.groupBy(bucket_label("created_at").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("total_jobs"), count_if(fake).alias("fake_jobs")
    )
    return counts.select(
        "timestamp",
        "total_jobs",
        "fake_jobs",
        F.greatest(F.col("total_jobs") - F.col("fake_jobs"), F.lit(0)).alias("real_jobs"),
        (F.col("total_jobs") / 3600).alias("throughput"),
    )


def metric_delta(series: DataFrame, value: str, order: str = "bucket_start") -> DataFrame:
    """Change of the last value against the one before in per cent, one place.

    The value before is at least 1; fewer than two values give 0.
    """
    last = series.agg(F.max_by(F.col(value), F.col(order)).alias("last"), F.max(order).alias("at"))
    at = last.select("at").scalar()
    before = series.filter(F.col(order) < at).agg(F.max_by(F.col(value), F.col(order)).alias("before"))
    floor = F.greatest(F.lit(1.0), before.scalar().cast("double"))
    change = F.round((F.col("last") - floor) / floor * 100, 1)
    known = before.scalar().isNotNull()
    return last.select(F.when(known, change).otherwise(0.0).alias("delta"))


def fake_rate_series(trends: DataFrame, last: int | None = None) -> DataFrame:
    """Share of fake postings per hour in per cent, one place; optionally the last n hours."""
    rows = trends.orderBy(F.desc("bucket_start")).limit(last) if last else trends
    rate = F.round(F.col("fake_jobs") / F.greatest(F.col("total_jobs"), F.lit(1)) * 100, 1)
    return rows.select("bucket_start", "timestamp", rate.alias("fake_rate"))


def rolling_history(series: DataFrame, value: str, order: str = "bucket_start", size: int = 12) -> DataFrame:
    """Per point the last ``size`` values. The series is a report, one row per
    hour, so its single window is as short as the report."""
    frame = Window.orderBy(order).rowsBetween(-(size - 1), 0)
    number = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    return series.select(order, F.collect_list(number).over(frame).alias("history"))


def peak_throughput(current: DataFrame, trends: DataFrame) -> DataFrame:
    """The larger of the present throughput and the best hour of the series."""
    best = trends.agg(F.coalesce(F.max("throughput"), F.lit(0.0))).scalar()
    return current.select(
        F.greatest(F.coalesce("throughput", F.lit(0.0)), best, F.lit(0.0)).alias("peak_throughput")
    )
