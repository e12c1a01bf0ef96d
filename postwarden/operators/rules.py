"""Rule tags and the risk score of a posting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, FREE_EMAIL_DOMAINS, REASON_KEYWORDS, SUSPICIOUS_KEYWORDS, Config
from ..functions.scalars import clamp01, is_one, or_blank, safe_double, safe_int

# Reason texts and patterns.
MISSING_COMPANY = "Missing company information"
SUSPICIOUS_LANGUAGE = "Suspicious language pattern"
LOW_DETAIL = "Low-detail job description"
NORMAL_PATTERN = "Normal posting pattern"
DEFAULT_REASON = "Model scoring result"
SHORT_LINE = r"^.{0,39}$"
EXTERNAL_URL = r"\bhttps?://[^\s]+\b"

_BODY, _WHOLE = "_body", "_whole"


def posting_reason(df: DataFrame, name: str = "reason") -> DataFrame:
    """First rule that applies: no company, a rule word, a short one-line text."""
    # lower case once, in a projection of its own
    staged = df.withColumn(_BODY, F.lower(or_blank("combined_text")))
    return staged.withColumn(name, _reason(F.col(_BODY))).drop(_BODY)


def _reason(body: Column) -> Column:
    words = r"\b(" + "|".join(REASON_KEYWORDS) + r")\b"
    # the plain search spares most texts the pattern
    worded = _holds_any(body, REASON_KEYWORDS) & body.rlike(words)
    return (
        F.when(F.trim(or_blank("company")) == "", MISSING_COMPANY)
        .when(worded, SUSPICIOUS_LANGUAGE)
        .when(F.trim(or_blank("description")).rlike(SHORT_LINE), LOW_DETAIL)
        .otherwise(NORMAL_PATTERN)
    )


def _holds_any(body: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(body, F.lit(w)) for w in words])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hits(body: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(body, F.lit(k)), k) for k in SUSPICIOUS_KEYWORDS]))


def _domain(body: Column) -> Column:
    mails = [
        F.when(F.contains(body, F.lit(d)), F.lit(f"free_email_domain:{d}")) for d in FREE_EMAIL_DOMAINS
    ]
    link = F.contains(body, F.lit("http")) & body.rlike(EXTERNAL_URL)
    return F.coalesce(*mails, F.when(link, F.lit("contains_external_url")))


def keyword_hits(text: Column | str) -> Column:
    """Suspicious words contained in the text, inside longer words too."""
    return _once(F.lower(or_blank(text)), _hits)


def domain_pattern(company: Column | str, text: Column | str) -> Column:
    """The first free mail domain named, else a mark for an outside link, else NULL."""
    return _once(F.lower(F.concat_ws(" ", or_blank(company), or_blank(text))), _domain)


def base_score(prediction: Column | str = "prediction", confidence: Column | str = "confidence") -> Column:
    """Confidence of fraud: as given for class 1, its complement otherwise."""
    sure = clamp01(safe_double(confidence))
    return F.when(safe_int(prediction) == 1, sure).otherwise(1.0 - sure)


def tag_postings(df: DataFrame) -> DataFrame:
    """Add the rule columns: reason, hits, suspicious_keywords, domain_pattern, is_scorable."""
    text = or_blank("combined_text")
    staged = df.withColumns(
        {_BODY: F.lower(text), _WHOLE: F.lower(F.concat_ws(" ", or_blank("company"), text))}
    )
    body = F.col(_BODY)
    columns = {
        "hits": _hits(body),
        "domain_pattern": _domain(F.col(_WHOLE)),
        "is_scorable": F.trim(body) != "",
    }
    if "reason" not in df.columns:
        columns["reason"] = _reason(body)
    tagged = staged.withColumns(columns).drop(_BODY, _WHOLE)
    return tagged.withColumn("suspicious_keywords", F.array_join("hits", ","))


def risk_score(
    base: Column, hits: Column, domain: Column, surge: Column, config: Config = DEFAULT
) -> Column:
    """Base score plus bonuses for rule words, a mail domain or link, and a surge."""
    words = F.least(F.lit(config.keyword_cap), F.size(hits) * F.lit(config.keyword_weight))
    link = F.when(domain.isNotNull(), F.lit(config.domain_weight)).otherwise(F.lit(0.0))
    burst = F.when(surge, F.lit(config.anomaly_weight)).otherwise(F.lit(0.0))
    return clamp01(base + words + link + burst)


def reason_tags(reason: Column, hits: Column, domain: Column, surge: Column, surge_reason: Column) -> Column:
    return F.array_compact(
        F.concat(
            F.array(reason),
            F.transform(hits, lambda h: F.concat(F.lit("keyword:"), h)),
            F.array(domain, F.when(surge, F.concat(F.lit("batch_anomaly:"), or_blank(surge_reason)))),
        )
    )


def scored_record(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The record stored for a scored posting.

    Input: a scored posting with combined_text, prediction, confidence and, when
    known, batch_is_anomaly with batch_anomaly_reason. Only rows of class 1 take
    part in a surge.
    """
    tagged = tag_postings(df)
    surge_flag = F.col("batch_is_anomaly") if "batch_is_anomaly" in df.columns else F.lit(False)
    surge_text = (
        F.col("batch_anomaly_reason") if "batch_anomaly_reason" in df.columns else F.lit(None).cast("string")
    )
    pick = lambda name, other: F.col(name) if name in df.columns else F.lit(other)
    staged = tagged.withColumns(
        {
            "prediction": safe_int("prediction"),
            "confidence": clamp01(safe_double("confidence")),
            "reason": F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit(DEFAULT_REASON)),
            "base": base_score(),
            "is_anomaly": F.coalesce(surge_flag, F.lit(False)) & is_one(safe_int("prediction")),
            "surge_text": surge_text,
        }
    )
    risk = risk_score(F.col("base"), F.col("hits"), F.col("domain_pattern"), F.col("is_anomaly"), config)
    return staged.select(
        or_blank("job_id").alias("job_id"),
        or_blank("title").alias("title"),
        "prediction",
        "confidence",
        "reason",
        reason_tags(
            F.col("reason"), F.col("hits"), F.col("domain_pattern"), F.col("is_anomaly"), F.col("surge_text")
        ).alias("reason_tags"),
        risk.alias("risk_score"),
        "is_anomaly",
        F.when(F.col("is_anomaly"), F.col("surge_text")).alias("anomaly_reason"),
        F.col("base").alias("original_score"),
        risk.alias("updated_score"),
        or_blank("combined_text").alias("combined_text"),
        or_blank(F.col("event_timestamp").cast("string")).alias("event_timestamp"),
        "suspicious_keywords",
        "domain_pattern",
        F.coalesce(pick("kafka_partition", 0), F.lit(0)).cast("int").alias("kafka_partition"),
        F.coalesce(pick("kafka_offset", 0), F.lit(0)).cast("bigint").alias("kafka_offset"),
    )
