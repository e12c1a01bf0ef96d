"""The given tables in the roles the operators expect.

``postings`` and ``training`` come from documents and labels, everything about
stored predictions from events. No given text holds a rule word, so postings get
phrases by document number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import ntz
from ..operators.alerts import alert_from_prediction
from ..operators.features import combined_text
from ..operators.metrics import batch_metrics
from ..operators.pressure import corrected_table, correction_history

# Phrases put into postings, title endings and reasons of predictions.
PHRASES = (
    (11, " urgent wire transfer"),
    (13, " contact me@gmail.com"),
    (17, " see https://x.example.com/a"),
    (19, " urgently hiring"),
)
TITLE_ENDS = ("", " remote engineer", " data analyst", " team lead", " designer", " developer")
REASONS = (
    "Missing company information",
    "Suspicious language pattern",
    "Low-detail job description",
    "Normal posting pattern",
    " ",
    "duplicate posting keyword",
    "salary domain mismatch",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(number: Column, texts: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (number % len(texts) + 1).cast("int"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "source")


def postings(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.concat("text", *[F.when(d % n == 0, phrase).otherwise("") for n, phrase in PHRASES])
    minute = F.timestamp_micros(F.lit(1_704_067_200_000_000) + d * 60_000_000)
    return documents(spark, sf).select(
        d.cast("string").alias("job_id"),
        "doc_id",
        F.array_join(F.slice(F.split("text", r"\s+", 7), 1, 6), " ").alias("title"),
        text.alias("description"),
        F.when(d % 7 == 0, "").otherwise(F.col("source")).alias("company"),
        F.when(d % 23 == 0, "bad-time")
        .otherwise(F.date_format(minute, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("event_timestamp"),
        ntz(minute).alias("created_at"),
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return combined_text(postings(spark, sf))


def training(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    d = F.col("doc_id")
    return (
        postings(spark, sf)
        .join(labels, "doc_id")
        .select(
            "job_id",
            "doc_id",
            F.when(d % 31 != 0, F.col("title")).alias("title"),
            F.when(F.col("company") != "", F.col("company")).alias("company_profile"),
            "description",
            F.when(d % 3 == 0, F.lit("requires degree")).alias("requirements"),
            F.when(d % 2 == 0, F.lit("10-20")).alias("salary_range"),
            F.when(d % 5 != 0, F.col("quality").cast("bigint")).alias("quality"),
            F.when(d % 4 != 0, F.length("description").cast("double")).alias("length"),
            F.lit(None).cast("double").alias("nothing"),
            F.col("toxic").alias("fraudulent"),
        )
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Postings with a class and a confidence that follow from the document number."""
    d = F.col("doc_id")
    return texts(spark, sf).select(
        "job_id",
        "doc_id",
        "title",
        "description",
        "company",
        "event_timestamp",
        "combined_text",
        F.when(d % 5 == 0, 1).otherwise(0).alias("prediction"),
        F.when(d % 37 == 0, F.lit(None).cast("double")).otherwise((d % 113) / 100).alias("confidence"),
        (d % 2 == 0).alias("batch_is_anomaly"),
        F.lit("fraud_rate_spike:0.600>=0.550").alias("batch_anomaly_reason"),
        (d % 3).cast("int").alias("kafka_partition"),
        d.alias("kafka_offset"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    fraud = F.col("event_type") == "error"
    base = F.when(fraud, F.col("confidence")).otherwise(1.0 - F.col("confidence"))
    rows = events.withColumn("confidence", F.least(F.lit(1.0), F.col("value") / 500)).withColumn("k", k)
    rows = rows.withColumn("base", base).withColumn("reason", pick(e, REASONS))
    domain = F.when(F.col("k") % 8 == 0, "free_email_domain:gmail.com")
    return rows.select(
        e.alias("id"),
        F.concat(F.lit("job-"), e.cast("string")).alias("job_id"),
        F.concat("event_type", pick(e, TITLE_ENDS)).alias("title"),
        F.when(fraud, 1).otherwise(0).alias("prediction"),
        "confidence",
        "reason",
        F.array("reason", F.coalesce(domain, F.lit(""))).alias("reason_tags"),
        F.col("base").alias("risk_score"),
        (F.col("k") >= 90).alias("is_anomaly"),
        F.when(F.col("k") >= 90, "fraud_count_spike").alias("anomaly_reason"),
        F.when(F.col("k") % 9 == 0, "urgent,crypto").otherwise("").alias("suspicious_keywords"),
        domain.alias("domain_pattern"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - F.col("k") * 1_000_000).alias(
            "event_timestamp"
        ),
        F.concat(F.lit("cluster_"), F.col("user_id").cast("string")).alias("cluster_id"),
        F.lit(1).alias("version"),
        F.lit(False).alias("is_corrected"),
        F.col("base").alias("original_score"),
        F.col("base").alias("updated_score"),
        F.lit(None).cast("string").alias("correction_reason"),
        F.concat("event_type", pick(e, TITLE_ENDS)).alias("text_blob"),
        F.col("ts").alias("created_at"),
    )


def events_k(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the number of their properties."""
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def as_of(spark: SparkSession, sf: str) -> Column:
    return table(spark, sf, "events").agg(F.max("ts").alias("as_of")).scalar()


def memberships(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).select("cluster_id", "job_id", "created_at")


def corrected_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return corrected_table(predictions(spark, sf), memberships(spark, sf), as_of(spark, sf))


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    return correction_history(predictions(spark, sf), memberships(spark, sf))


def batch_rows(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("k")
    return events_k(spark, sf).select(
        F.floor(e / 700).alias("batch_id"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("prediction"),
        (k >= 90).alias("is_anomaly"),
        (k % 17 != 0).alias("inserted"),
        F.when(e % 23 != 0, k * F.lit(1000.0)).alias("latency_ms"),
        F.col("ts").alias("started_at"),
        F.col("ts").alias("insert_done_at"),
        (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("completed_at"),
    )


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return batch_metrics(batch_rows(spark, sf)).withColumns(
        {
            "kafka_lag": F.col("batch_id") * 7,
            "queue_backlog": (F.col("batch_id") % 13).cast("int"),
            # the time of its newest row, so that the newest batch lies within the reports
            "created_at": F.col("batch_completed_at") - F.expr("INTERVAL 1 SECOND"),
        }
    )


def offsets(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        (e % 3).alias("kafka_partition"), F.floor(e / 3).alias("kafka_offset")
    )


def end_offsets(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("kafka_partition")
    ends = offsets(spark, sf).groupBy(p.alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    return ends.select("partition", (F.col("n") + 5 * F.col("partition")).alias("end_offset"))


def retry_queue(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    failed = events_k(spark, sf).filter(F.col("event_type") == "error")
    return failed.select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
        F.col("event_type").alias("title"),
        F.lit(1).alias("prediction"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"),
        pick(F.col("event_id"), REASONS).alias("reason"),
        F.col("ts").alias("queued_at"),
        (k % 9).alias("attempts"),
        (F.col("ts") + F.make_dt_interval(mins=k)).alias("next_retry_at"),
        F.when(k % 4 == 0, "").otherwise("db_insert").alias("failure_stage"),
        F.when(k % 5 == 0, "").otherwise("timeout").alias("failure_reason"),
        F.when(k % 3 == 0, "connection reset").alias("last_error"),
    )


def health_samples(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return events_k(spark, sf).select(
        F.col("user_id").alias("deployment"),
        ntz(F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("event_id") * 100_000)).alias("sample_at"),
        (k != 0).alias("kafka_running"),
        (k != 1).alias("db_connected"),
        (k != 2).alias("ml_loaded"),
        (k % 3).alias("recent_jobs"),
        (F.col("value") * 10).cast("bigint").alias("kafka_lag"),
    )


def alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    return alert_from_prediction(corrected_predictions(spark, sf))


def match_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each event against the three before it of the same user."""
    order = Window.partitionBy("user_id").orderBy("ts")
    before = {f"{c}_{n}": F.lag(c, n).over(order) for n in (1, 2, 3) for c in ("event_id", "ts")}
    seen = lambda n: F.struct(
        F.col(f"event_id_{n}").alias("other"),
        F.col(f"ts_{n}").alias("at"),
        ((F.col("k") * n) % 10 / F.lit(10.0)).alias("similarity"),
    )
    pairs = (
        events_k(spark, sf)
        .withColumns(before)
        .select("event_id", F.explode(F.array(seen(1), seen(2), seen(3))).alias("p"))
    )
    return pairs.filter("p.other IS NOT NULL").select(
        F.col("event_id").alias("job_id"),
        F.col("p.other").alias("match_job_id"),
        "p.similarity",
        F.col("p.at").alias("match_time"),
    )
