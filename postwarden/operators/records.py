"""Shaping rows for the stored tables and for readers of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions.scalars import (
    as_time,
    clamp01,
    micros,
    non_blank,
    or_blank,
    parse_time,
    safe_bool,
    safe_double,
    safe_int,
    strip,
)
from .rules import base_score

# Texts shown where a field is missing.
UNTITLED = "Untitled Posting"
NO_EXPLANATION = "Model explanation unavailable"
UPGRADE = "UPGRADE_TO_FRAUD"
INCREASE = "RISK_INCREASE"


def _maybe(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def sanitize_prediction(df: DataFrame) -> DataFrame:
    """Casts, clamps and defaults applied to a record before it is stored."""
    get = lambda name, kind="string": _maybe(df, name, kind)
    original = clamp01(safe_double(get("original_score"), base_score(get("prediction"), get("confidence"))))
    fallback = F.when(F.col("updated_score") > 0, F.col("updated_score")).otherwise(F.col("original_score"))
    tags = (
        F.col("reason_tags")
        if dict(df.dtypes).get("reason_tags") == "array<string>"
        else F.from_json(get("reason_tags_json"), "array<string>")
    )
    made_id = F.sha2(
        F.to_json(F.struct(*[F.col(c).cast("string") for c in df.columns if not c.startswith("reason_tags")])), 256
    )
    first = df.select(
        F.coalesce(non_blank(get("job_id")), made_id).alias("job_id"),
        non_blank(get("title")).alias("title"),
        safe_int(get("prediction")).alias("prediction"),
        clamp01(safe_double(get("confidence"))).alias("confidence"),
        non_blank(get("reason")).alias("reason"),
        tags.alias("reason_tags"),
        safe_bool(get("is_anomaly"), False).alias("is_anomaly"),
        non_blank(get("anomaly_reason")).alias("anomaly_reason"),
        non_blank(get("suspicious_keywords")).alias("suspicious_keywords"),
        non_blank(get("domain_pattern")).alias("domain_pattern"),
        parse_time(get("event_timestamp").cast("string")).alias("event_timestamp"),
        non_blank(get("cluster_id")).alias("cluster_id"),
        F.greatest(F.lit(1), safe_int(get("version"), 1)).alias("version"),
        safe_bool(get("is_corrected"), False).alias("is_corrected"),
        original.alias("original_score"),
        get("updated_score").cast("string").alias("_updated"),
        get("risk_score").cast("string").alias("_risk"),
        non_blank(get("correction_reason")).alias("correction_reason"),
        F.coalesce(non_blank(get("combined_text")), non_blank(get("text_blob"))).alias("text_blob"),
    )
    return (
        first.withColumn("updated_score", clamp01(safe_double("_updated", F.col("original_score"))))
        .withColumn("risk_score", clamp01(safe_double("_risk", fallback)))
        .drop("_updated", "_risk")
    )


def upgrade_predictions(df: DataFrame) -> DataFrame:
    """Bring an older predictions table to the present columns and fill the gaps."""
    have = dict(df.dtypes)
    full = df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.PREDICTION.fields
        ]
    )
    sure = F.coalesce("confidence", F.lit(0.0))
    derived = F.when(F.col("prediction") == 1, sure).otherwise(F.greatest(F.lit(0.0), 1.0 - sure))
    original = F.coalesce("original_score", derived)
    updated = F.coalesce("updated_score", original)
    return full.withColumns(
        {
            "version": F.coalesce("version", F.lit(1)),
            "is_corrected": F.coalesce("is_corrected", F.lit(False)),
            "original_score": original,
            "updated_score": updated,
            "risk_score": F.coalesce(F.col("risk_score"), updated),
            "is_anomaly": F.coalesce("is_anomaly", F.lit(False)),
        }
    )


def upgrade_corrections(df: DataFrame) -> DataFrame:
    kind = F.col("correction_type") if "correction_type" in df.columns else F.lit(None).cast("string")
    return df.withColumn("correction_type", F.coalesce(kind, F.lit(INCREASE)))


def prediction_label(c: Column | str) -> Column:
    """FAKE for 1 or the text 'fake' in any case, else REAL."""
    value = F.upper(strip((F.col(c) if isinstance(c, str) else c).cast("string")))
    return F.when((value == "FAKE") | (value.try_cast("double") == 1), "FAKE").otherwise("REAL")


def latency_ms(later: Column, earlier: Column) -> Column:
    """Milliseconds from one time to another, never negative, NULL if one is missing."""
    gap = (micros(later) - micros(earlier)) / F.lit(1000.0)
    return F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap))


def event_latency_ms(
    df: DataFrame, as_of: Column | datetime | str, source: str = "event_timestamp", name: str = "latency_ms"
) -> DataFrame:
    return df.withColumn(name, latency_ms(as_time(as_of), parse_time(F.col(source).cast("string"))))


def serve_prediction(df: DataFrame) -> DataFrame:
    """A stored prediction as readers see it."""
    sure = F.coalesce(F.col("confidence"), F.lit(0.0))
    label = prediction_label(F.coalesce(F.col("prediction"), F.lit(0)))
    original = F.coalesce(F.col("original_score"), F.lit(0.0))
    updated = F.coalesce(F.col("updated_score"), original)
    risk = F.when(updated > 0, updated).otherwise(
        F.when(label == "FAKE", sure).otherwise(F.greatest(F.lit(0.0), 1.0 - sure))
    )
    tags = (
        F.col("reason_tags")
        if "reason_tags" in df.columns
        else F.from_json(_maybe(df, "reason_tags_json"), "array<string>")
    )
    return df.select(
        F.coalesce(F.col("id").cast("string"), or_blank("job_id")).alias("id"),
        "job_id",
        "title",
        "prediction",
        label.alias("label"),
        sure.alias("confidence"),
        clamp01(risk).alias("risk_score"),
        or_blank("reason").alias("reason"),
        F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: strip(t) != "").alias("reason_tags"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        "anomaly_reason",
        or_blank("suspicious_keywords").alias("suspicious_keywords"),
        "domain_pattern",
        "cluster_id",
        F.when(F.coalesce("version", F.lit(0)) == 0, 1).otherwise(F.col("version")).alias("version"),
        F.coalesce("is_corrected", F.lit(False)).alias("is_corrected"),
        clamp01(original).alias("original_score"),
        clamp01(updated).alias("updated_score"),
        "correction_reason",
        "event_timestamp",
        latency_ms(F.col("created_at"), F.col("event_timestamp")).alias("latency_ms"),
        "created_at",
    )


def processed_event(df: DataFrame) -> DataFrame:
    """The message published for a scored record."""
    tags = F.col("reason_tags")
    return df.select(
        or_blank("job_id").alias("id"),
        or_blank("title").alias("title"),
        F.coalesce("prediction", F.lit(0)).alias("prediction"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, tags)
        .otherwise(F.array(F.col("reason")))
        .alias("reason"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        "anomaly_reason",
        or_blank(F.col("event_timestamp").cast("string")).alias("timestamp"),
    )


def dead_letter_records(
    df: DataFrame,
    stage: Column | str | None,
    reason: Column | str | None,
    retry_count: Column | int = 0,
    source: str | None = None,
) -> DataFrame:
    """Failed records with the whole record as JSON."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    count = retry_count if isinstance(retry_count, Column) else F.lit(retry_count)
    return df.select(
        non_blank(_maybe(df, "job_id")).alias("job_id"),
        non_blank(_maybe(df, "title")).alias("title"),
        safe_int(_maybe(df, "prediction")).alias("prediction"),
        safe_double(_maybe(df, "confidence")).alias("confidence"),
        non_blank(_maybe(df, "reason")).alias("reason"),
        F.to_json(F.struct("*")).alias("payload_json"),
        F.greatest(F.lit(0), F.coalesce(count.try_cast("int"), F.lit(0))).alias("retry_count"),
        F.coalesce(non_blank(as_column(stage)), F.lit("unknown_stage")).alias("failure_stage"),
        F.coalesce(non_blank(as_column(reason)), F.lit("unknown_failure")).alias("failure_reason"),
        F.coalesce(non_blank(as_column(source)), F.lit("spark_stream")).alias("source"),
    )


def normalize_unit(c: Column | str) -> Column:
    """A share given as unit or per cent, brought to 0..1; no number is 0."""
    value = safe_double(c)
    return clamp01(F.when(value > 1, value / 100).otherwise(value))


def normalize_corrections(df: DataFrame) -> DataFrame:
    """Corrections from outside: valid type, clamped scores, a title and a reason."""
    kind = F.upper(strip(or_blank(_maybe(df, "correction_type"))))
    new = safe_double("new_score")
    return df.select(
        "job_id",
        F.coalesce(_maybe(df, "job_title"), _maybe(df, "title"), F.lit(UNTITLED)).alias("job_title"),
        _maybe(df, "cluster_id").alias("cluster_id"),
        F.when(kind.isin(UPGRADE, INCREASE), kind)
        .otherwise(F.when(new >= 0.8, UPGRADE).otherwise(INCREASE))
        .alias("correction_type"),
        clamp01(safe_double("old_score")).alias("old_score"),
        clamp01(new).alias("new_score"),
        F.coalesce(non_blank("reason"), F.lit(NO_EXPLANATION)).alias("reason"),
        "updated_at",
    )


def fraud_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("prediction") == 1)


def job_id_prefix_count(df: DataFrame, prefix: str) -> DataFrame:
    return df.filter(F.col("job_id").startswith(prefix)).agg(F.count(F.lit(1)).alias("n"))
