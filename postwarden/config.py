"""Thresholds and rule lists, in one frozen object that every operator takes."""

from __future__ import annotations

from dataclasses import dataclass

# Rule words, tag texts and thresholds that results depend on.
FREE_EMAIL_DOMAINS = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "proton.me")
SUSPICIOUS_KEYWORDS = (
    "urgent",
    "telegram",
    "whatsapp",
    "wire transfer",
    "crypto",
    "no experience",
    "quick money",
    "immediate start",
)
REASON_KEYWORDS = (
    "urgent",
    "wire transfer",
    "crypto",
    "telegram",
    "whatsapp",
    "no experience",
    "quick money",
)
STOP_WORDS = (
    "and",
    "the",
    "for",
    "with",
    "from",
    "that",
    "this",
    "job",
    "posting",
    "model",
    "flagged",
    "fraud",
    "risk",
    "high",
    "low",
    "detected",
)
TEXT_COLUMNS = ("title", "company_profile", "description", "requirements")


@dataclass(frozen=True)
class Config:
    # rules
    keyword_weight: float = 0.05
    keyword_cap: float = 0.25
    domain_weight: float = 0.12
    anomaly_weight: float = 0.15
    # surge detection
    ema_alpha: float = 0.2
    spike_multiplier: float = 2.2
    rate_multiplier: float = 1.8
    rate_floor: float = 0.55
    min_fraud_count: int = 8
    # clustering
    similarity_threshold: float = 0.8
    lookback_hours: int = 24
    # terms of the classifier's input; similarity uses all terms
    max_features: int = 5000
    # pressure and corrections
    pressure_multiplier: float = 0.5
    correction_delta: float = 0.3
    hard_flip: float = 2.0
    # retry
    max_attempts: int = 8
    max_backlog: int = 20000
    retry_batch: int = 200
    max_retry_wait_s: int = 60
    # streaming
    max_offsets_per_trigger: int = 700
    trigger_interval: str = "5 seconds"
    # health
    down_lag: int = 2000
    recovery_seconds: int = 30
    # layout: rows one task should hold for one key, and rows of a slice that
    # splits a key's history in running sums and folds
    hot_key_rows: int = 1_000_000
    slice_rows: int = 20_000


DEFAULT = Config()
