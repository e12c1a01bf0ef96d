"""The same roles as SQL fragments for the check engine."""

from __future__ import annotations

import re

from ..config import FREE_EMAIL_DOMAINS, REASON_KEYWORDS, SUSPICIOUS_KEYWORDS
from .fixtures import PHRASES, REASONS, TITLE_ENDS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chosen(number: str, texts: tuple[str, ...]) -> str:
    listed = ", ".join(quoted(t) for t in texts)
    return f"(list_value({listed}))[1 + ({number}) % {len(texts)}]"


_PHRASES = " || ".join(f"CASE WHEN doc_id % {n} = 0 THEN {quoted(p)} ELSE '' END" for n, p in PHRASES)
_K = r"CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER)"
REASON_TEXT = """'Fraud escalation detected:' || chr(10) || '- ' || count_1h || ' similar jobs detected in 1 hour'
  || chr(10) || '- Pattern repetition confirmed' || chr(10)
  || '- Cluster risk threshold exceeded (cluster=' || cluster_id || ', pressure='
  || printf('%.2f', pressure_score) || ', 24h=' || count_24h || ')'"""


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def clean(c: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')")


def alert_columns(score: str, missing: str) -> str:
    return f"""
  CAST(id AS VARCHAR) AS id, job_id, title AS job_title, round(({score}) * 100, 2) AS risk, {score} AS risk_score,
  CASE WHEN is_corrected THEN 'UPDATED FRAUD DETECTION: ' || coalesce(nullif(correction_reason, ''),
      nullif(reason, ''), {quoted(missing)})
    ELSE coalesce(nullif(reason, ''), 'Model flagged suspicious fraud pattern.') END AS reason,
  created_at AS "timestamp",
  CASE WHEN is_corrected OR round(({score}) * 100, 2) >= 90 THEN 'critical'
    WHEN round(({score}) * 100, 2) >= 75 THEN 'warning' ELSE 'info' END AS level,
  is_corrected, cluster_id, correction_reason"""


PREDICTION_COLUMNS = (
    "id, job_id, title, prediction, confidence, reason, risk_score, is_anomaly, anomaly_reason, "
    "suspicious_keywords, domain_pattern, event_timestamp, cluster_id, version, is_corrected, original_score, "
    "updated_score, correction_reason, text_blob, created_at"
)

CTES: dict[str, str] = {
    "clock": "SELECT max(ts) AS as_of FROM events",
    "postings": rf"""
SELECT CAST(doc_id AS VARCHAR) AS job_id, doc_id,
  array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 1, 6), ' ') AS title,
  text || {_PHRASES} AS description,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS company,
  CASE WHEN doc_id % 23 = 0 THEN 'bad-time'
    ELSE strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%SZ') END AS event_timestamp,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at
FROM documents""",
    "texts": "SELECT *, lower(title || ' ' || description || ' ' || company) AS combined_text FROM postings",
    "training": """
SELECT p.job_id, p.doc_id, CASE WHEN p.doc_id % 31 <> 0 THEN title END AS title,
  CASE WHEN company <> '' THEN company END AS company_profile, description,
  CASE WHEN p.doc_id % 3 = 0 THEN 'requires degree' END AS requirements,
  CASE WHEN p.doc_id % 2 = 0 THEN '10-20' END AS salary_range,
  CASE WHEN p.doc_id % 5 <> 0 THEN quality END AS quality,
  CASE WHEN p.doc_id % 4 <> 0 THEN CAST(length(description) AS DOUBLE) END AS length,
  CAST(NULL AS DOUBLE) AS nothing, toxic AS fraudulent
FROM postings p JOIN labels l ON p.doc_id = l.doc_id""",
    "training_texts": f"""
SELECT *, {clean("coalesce(title, '') || ' ' || coalesce(company_profile, '') || ' ' || description || ' ' || coalesce(requirements, '')")}
  AS combined_text FROM training""",
    "scored": """
SELECT job_id, doc_id, title, description, company, event_timestamp, combined_text,
  CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS prediction,
  CASE WHEN doc_id % 37 = 0 THEN NULL ELSE (doc_id % 113) / 100.0::DOUBLE END AS confidence,
  doc_id % 2 = 0 AS batch_is_anomaly, 'fraud_rate_spike:0.600>=0.550' AS batch_anomaly_reason,
  CAST(doc_id % 3 AS INTEGER) AS kafka_partition, doc_id AS kafka_offset
FROM texts""",
    "tagged": f"""
SELECT *,
  CASE WHEN trim(company) = '' THEN 'Missing company information'
    WHEN regexp_matches(combined_text, '\\b({"|".join(REASON_KEYWORDS)})\\b') THEN 'Suspicious language pattern'
    WHEN regexp_matches(trim(description), '^.{{0,39}}$') THEN 'Low-detail job description'
    ELSE 'Normal posting pattern' END AS reason,
  list_filter([{", ".join(quoted(k) for k in SUSPICIOUS_KEYWORDS)}], lambda w: contains(combined_text, w)) AS hits,
  CASE {" ".join(f"WHEN contains(lower(company || ' ' || combined_text), '{d}') THEN 'free_email_domain:{d}'" for d in FREE_EMAIL_DOMAINS)}
    WHEN regexp_matches(lower(company || ' ' || combined_text), '\\bhttps?://[^\\s]+\\b') THEN 'contains_external_url'
    END AS domain_pattern,
  CASE WHEN prediction = 1 THEN least(1, greatest(0, coalesce(confidence, 0)))
    ELSE 1 - least(1, greatest(0, coalesce(confidence, 0))) END AS base,
  batch_is_anomaly AND prediction = 1 AS surge
FROM scored""",
    "records": """
SELECT *, least(1, greatest(0, base + least(0.25::DOUBLE, 0.05::DOUBLE * len(hits))
    + CASE WHEN domain_pattern IS NOT NULL THEN 0.12::DOUBLE ELSE 0 END
    + CASE WHEN surge THEN 0.15::DOUBLE ELSE 0 END)) AS risk,
  array_to_string(list_concat(list_concat([reason], list_transform(hits, lambda h: 'keyword:' || h)),
    list_filter([domain_pattern, CASE WHEN surge THEN 'batch_anomaly:' || batch_anomaly_reason END],
      lambda t: t IS NOT NULL)), '|') AS tags
FROM tagged""",
    "ev": f"SELECT *, {_K} AS k FROM events",
    "predictions": f"""
SELECT event_id AS id, 'job-' || event_id AS job_id, event_type || {chosen('event_id', TITLE_ENDS)} AS title,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS prediction, confidence, {chosen('event_id', REASONS)} AS reason,
  base AS risk_score, k >= 90 AS is_anomaly, CASE WHEN k >= 90 THEN 'fraud_count_spike' END AS anomaly_reason,
  CASE WHEN k % 9 = 0 THEN 'urgent,crypto' ELSE '' END AS suspicious_keywords,
  CASE WHEN k % 8 = 0 THEN 'free_email_domain:gmail.com' END AS domain_pattern,
  ts - to_seconds(k) AS event_timestamp, 'cluster_' || user_id AS cluster_id, 1 AS version,
  false AS is_corrected, base AS original_score, base AS updated_score, CAST(NULL AS VARCHAR) AS correction_reason,
  event_type || {chosen('event_id', TITLE_ENDS)} AS text_blob, ts AS created_at, k
FROM (SELECT *, CASE WHEN event_type = 'error' THEN confidence ELSE 1 - confidence END AS base
  FROM (SELECT *, least(1.0::DOUBLE, value / 500) AS confidence FROM ev))""",
    "members": "SELECT cluster_id, job_id, created_at FROM predictions",
    "pressure": """
SELECT *, ln(count_24h + 1) AS pressure_score FROM (
  SELECT cluster_id,
    count(*) FILTER (WHERE created_at > as_of - INTERVAL 1 HOUR AND created_at <= as_of) AS count_1h,
    count(*) FILTER (WHERE created_at > as_of - INTERVAL 6 HOUR AND created_at <= as_of) AS count_6h,
    count(*) FILTER (WHERE created_at > as_of - INTERVAL 24 HOUR AND created_at <= as_of) AS count_24h
  FROM members, clock GROUP BY cluster_id)""",
    "corrected": f"""
SELECT *, replace(new_reason, chr(10), ' ') AS flat FROM (
SELECT *, {REASON_TEXT} AS new_reason FROM (
  SELECT p.*, count_1h, count_24h, pressure_score, original_score AS base_score, updated_score AS old_score,
    least(1, original_score + pressure_score * 0.5::DOUBLE) AS new_score,
    CASE WHEN pressure_score > 2 AND prediction <> 1 THEN 'UPGRADE_TO_FRAUD' ELSE 'RISK_INCREASE' END AS correction_type
  FROM predictions p JOIN pressure USING (cluster_id))
WHERE new_score - base_score > 0.3::DOUBLE)""",
    "versions": """
SELECT p.id, p.job_id, p.title,
  CASE WHEN c.job_id IS NOT NULL AND c.pressure_score > 2 THEN 1 ELSE p.prediction END AS prediction, p.confidence,
  CASE WHEN c.job_id IS NULL THEN p.reason
    WHEN c.correction_type = 'UPGRADE_TO_FRAUD' THEN 'UPDATED FRAUD DETECTION: ' || c.flat
    ELSE 'UPDATED RISK ESCALATION: ' || c.flat END AS reason,
  p.risk_score, p.is_anomaly, p.anomaly_reason, p.suspicious_keywords, p.domain_pattern, p.event_timestamp,
  p.cluster_id, CASE WHEN c.job_id IS NULL THEN 1 ELSE 2 END AS version, c.job_id IS NOT NULL AS is_corrected,
  p.original_score, coalesce(c.new_score, p.updated_score) AS updated_score, c.new_reason AS correction_reason,
  p.text_blob, p.created_at
FROM predictions p LEFT JOIN corrected c ON p.job_id = c.job_id""",
    "timeline": """
SELECT a.cluster_id, a.created_at,
  count(*) FILTER (WHERE b.created_at > a.created_at - INTERVAL 1 HOUR) AS count_1h,
  count(*) FILTER (WHERE b.created_at > a.created_at - INTERVAL 6 HOUR) AS count_6h,
  count(*) AS count_24h, ln(count(*) + 1) AS pressure_score
FROM (SELECT DISTINCT cluster_id, created_at FROM members) a JOIN members b
  ON a.cluster_id = b.cluster_id AND b.created_at <= a.created_at
  AND b.created_at > a.created_at - INTERVAL 24 HOUR
GROUP BY a.cluster_id, a.created_at""",
    "steps": """
SELECT p.job_id, p.cluster_id, p.updated_score AS start_score, p.prediction AS start_class, t.created_at AS updated_at,
  count_1h, count_24h, pressure_score, least(1, original_score + pressure_score * 0.5::DOUBLE) AS new_score,
  pressure_score > 2 AS hard
FROM predictions p JOIN timeline t ON p.cluster_id = t.cluster_id AND t.created_at >= p.created_at
WHERE least(1, original_score + pressure_score * 0.5::DOUBLE) - original_score > 0.3::DOUBLE""",
    "traced": """
SELECT *, lag(new_score) OVER w AS last_score,
  coalesce(bool_or(hard) OVER (PARTITION BY job_id ORDER BY updated_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
    OR start_class = 1 AS was_fraud
FROM steps WINDOW w AS (PARTITION BY job_id ORDER BY updated_at)""",
    "history": f"""
SELECT job_id, cluster_id, coalesce(last_score, start_score) AS old_score, new_score, {REASON_TEXT} AS reason,
  CASE WHEN hard AND NOT was_fraud THEN 'UPGRADE_TO_FRAUD' ELSE 'RISK_INCREASE' END AS correction_type, updated_at
FROM traced
WHERE last_score IS NULL OR abs(new_score - last_score) >= 1e-9 OR (hard AND NOT was_fraud)""",
    "history_jobs": """
SELECT h.job_id, p.title AS job_title, p.cluster_id, h.old_score, h.new_score, h.reason, h.correction_type, h.updated_at
FROM history h LEFT JOIN predictions p ON h.job_id = p.job_id ORDER BY h.updated_at DESC, h.job_id LIMIT 50""",
    "batch_rows": """
SELECT event_id // 700 AS batch_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS prediction,
  k >= 90 AS is_anomaly, k % 17 <> 0 AS inserted, CASE WHEN event_id % 23 <> 0 THEN k * 1000.0::DOUBLE END AS latency_ms,
  ts AS started_at, ts + INTERVAL 1 SECOND AS completed_at
FROM ev""",
    "batches": """
SELECT batch_id, min(started_at) AS batch_started_at, max(completed_at) AS batch_completed_at,
  count(*) AS jobs_received, count(*) FILTER (WHERE inserted) AS jobs_inserted,
  count(*) FILTER (WHERE NOT inserted) AS jobs_failed,
  epoch_us(max(completed_at)) / 1e6 - epoch_us(min(started_at)) / 1e6 AS raw_spent,
  (epoch_us(max(completed_at)) - epoch_us(min(started_at))) / 1e6 AS spent,
  (epoch_us(max(started_at)) - epoch_us(min(started_at))) / 1e3 AS db_insert_time_ms,
  coalesce(avg(latency_ms), 0) AS avg_latency_ms,
  count(*) FILTER (WHERE NOT inserted) / count(*) AS error_rate, sum(prediction) / count(*) AS fraud_rate,
  count(*) FILTER (WHERE is_anomaly) / count(*) AS anomaly_rate
FROM batch_rows GROUP BY batch_id""",
    "metrics": """
SELECT *, jobs_inserted / greatest(0.001, spent) AS throughput_jobs_per_sec, spent * 1000 AS spark_batch_time_ms,
  batch_id * 7 AS kafka_lag, CAST(batch_id % 13 AS INTEGER) AS queue_backlog, batch_completed_at - INTERVAL 1 SECOND AS created_at
FROM batches""",
    "dashboard": """
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE prediction = 1) AS fake_jobs,
  count(*) - count(*) FILTER (WHERE prediction = 1) AS real_jobs,
  round(count(*) FILTER (WHERE prediction = 1) / count(*) * 100, 2) AS fake_percentage,
  round(count(*) FILTER (WHERE created_at BETWEEN as_of - INTERVAL 1 MINUTE AND as_of) / 60, 2) AS throughput,
  avg(confidence) AS avg_confidence, max(created_at) AS last_processed_at,
  (epoch_us(any_value(as_of)) - epoch_us(max(created_at))) / 1000.0::DOUBLE AS processing_latency_ms,
  count(*) FILTER (WHERE is_corrected) AS corrected_jobs,
  (SELECT count(*) FROM (SELECT cluster_id FROM members, clock WHERE created_at BETWEEN as_of - INTERVAL 24 HOUR AND as_of
    GROUP BY cluster_id HAVING ln(count(*) + 1) > 1)) AS high_pressure_clusters
FROM versions, clock""",
    "system": """
SELECT b.throughput_jobs_per_sec, b.avg_latency_ms, b.error_rate,
  CASE WHEN p.n > 0 THEN p.fraud / p.n ELSE b.fraud_rate END AS fraud_rate,
  CASE WHEN p.n > 0 THEN p.anomaly / p.n ELSE b.anomaly_rate END AS anomaly_rate,
  CAST(floor(b.kafka_lag) AS BIGINT) AS kafka_lag, b.spark_batch_time_ms, b.db_insert_time_ms, b.queue_backlog, b.samples
FROM (SELECT coalesce(avg(throughput_jobs_per_sec), 0) AS throughput_jobs_per_sec,
    coalesce(avg(avg_latency_ms), 0) AS avg_latency_ms, coalesce(avg(error_rate), 0) AS error_rate,
    coalesce(avg(fraud_rate), 0) AS fraud_rate, coalesce(avg(anomaly_rate), 0) AS anomaly_rate,
    coalesce(avg(kafka_lag), 0) AS kafka_lag, coalesce(avg(spark_batch_time_ms), 0) AS spark_batch_time_ms,
    coalesce(avg(db_insert_time_ms), 0) AS db_insert_time_ms, coalesce(max(queue_backlog), 0) AS queue_backlog,
    count(*) AS samples
  FROM metrics, clock WHERE created_at BETWEEN as_of - INTERVAL 120 MINUTE AND as_of) b,
  (SELECT count(*) AS n, count(*) FILTER (WHERE prediction = 1) AS fraud, count(*) FILTER (WHERE is_anomaly) AS anomaly
   FROM predictions, clock WHERE created_at BETWEEN as_of - INTERVAL 120 MINUTE AND as_of) p""",
    "spine": """
SELECT unnest(generate_series(date_trunc('hour', as_of - INTERVAL 24 HOUR), date_trunc('hour', as_of), INTERVAL 1 HOUR))
  AS bucket_start FROM clock""",
    "trends": """
SELECT strftime(s.bucket_start, '%H:%M') AS "timestamp", s.bucket_start, coalesce(n, 0) AS total_jobs,
  coalesce(f, 0) AS fake_jobs, coalesce(n, 0) - coalesce(f, 0) AS real_jobs,
  round(coalesce(n, 0) / 3600, 3) AS throughput
FROM spine s LEFT JOIN (
  SELECT date_trunc('hour', created_at) AS b, count(*) AS n, count(*) FILTER (WHERE prediction = 1) AS f
  FROM predictions, clock WHERE created_at BETWEEN as_of - INTERVAL 24 HOUR AND as_of GROUP BY 1) a ON a.b = s.bucket_start""",
    "spikes": """
SELECT strftime(s.bucket_start, '%H:%M') AS "timestamp", s.bucket_start, coalesce(c.n, 0) AS cluster_jobs,
  coalesce(r.n, 0) AS corrections
FROM spine s
LEFT JOIN (SELECT date_trunc('hour', created_at) AS b, count(*) AS n FROM members, clock
  WHERE created_at BETWEEN as_of - INTERVAL 24 HOUR AND as_of GROUP BY 1) c ON c.b = s.bucket_start
LEFT JOIN (SELECT date_trunc('hour', updated_at) AS b, count(*) AS n FROM history, clock
  WHERE updated_at BETWEEN as_of - INTERVAL 24 HOUR AND as_of GROUP BY 1) r ON r.b = s.bucket_start""",
    "top": """
SELECT m.cluster_id, count(*) FILTER (WHERE m.created_at BETWEEN as_of - INTERVAL 1 HOUR AND as_of) AS jobs_1h,
  count(*) FILTER (WHERE m.created_at BETWEEN as_of - INTERVAL 6 HOUR AND as_of) AS jobs_6h, count(*) AS jobs_24h,
  ln(count(*) + 1) AS pressure_score, count(*) FILTER (WHERE v.is_corrected) AS corrected_jobs,
  coalesce(max(v.updated_score), 0) AS peak_score
FROM clock, members m LEFT JOIN versions v ON v.job_id = m.job_id
WHERE m.created_at BETWEEN as_of - INTERVAL 24 HOUR AND as_of GROUP BY m.cluster_id
ORDER BY pressure_score DESC, corrected_jobs DESC, jobs_24h DESC, m.cluster_id LIMIT 8""",
    "alert_rows": f"""
SELECT {alert_columns('least(1, greatest(0, coalesce(risk_score, updated_score, confidence, 0)))', 'Fraud escalation detected')}
FROM versions WHERE prediction = 1""",
    "alert_marks": """
SELECT *, CASE WHEN risk_score >= 0.9 OR level = 'critical' THEN 'critical'
    WHEN risk_score >= 0.7 OR level = 'warning' THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN contains(lower(reason), 'domain') THEN 'domain' WHEN contains(lower(reason), 'duplicate') THEN 'duplicate'
    WHEN contains(lower(reason), 'salary') THEN 'salary'
    WHEN contains(lower(reason), 'urgency') OR contains(lower(reason), 'pattern') THEN 'pattern'
    WHEN contains(lower(reason), 'keyword') THEN 'keyword' ELSE 'other' END AS category
FROM alert_rows""",
    "alert_titles": """
SELECT CASE WHEN contains(lower(job_title), 'remote') THEN 'Remote'
  WHEN contains(lower(job_title), 'engineer') OR contains(lower(job_title), 'developer') THEN 'Engineering'
  WHEN contains(lower(job_title), 'analyst') OR contains(lower(job_title), 'data') THEN 'Data'
  WHEN contains(lower(job_title), 'manager') OR contains(lower(job_title), 'lead') THEN 'Management'
  WHEN contains(lower(job_title), 'designer') THEN 'Design' ELSE 'General' END AS category FROM alert_rows""",
    "offsets": "SELECT event_id % 3 AS p, event_id // 3 AS o FROM events",
    "ends": "SELECT p, count(*) + 5 * p AS end_offset, max(o) + 1 AS next_offset FROM offsets GROUP BY p",
    "queue": f"""
SELECT 'job-' || event_id AS job_id, event_type AS title, least(1.0::DOUBLE, value / 500) AS confidence,
  {chosen('event_id', REASONS)} AS reason, ts AS queued_at, k % 9 AS attempts, ts + to_minutes(k) AS next_retry_at,
  CASE WHEN k % 4 = 0 THEN '' ELSE 'db_insert' END AS failure_stage,
  CASE WHEN k % 5 = 0 THEN '' ELSE 'timeout' END AS failure_reason,
  CASE WHEN k % 3 = 0 THEN 'connection reset' END AS last_error
FROM ev WHERE event_type = 'error'""",
    "health": """
SELECT *, array_to_string(list_filter([
    CASE WHEN kafka <> 'running' THEN 'Kafka Down - ingestion degraded' END,
    CASE WHEN spark = 'down' THEN 'Spark Down - streaming inference unavailable' END,
    CASE WHEN db <> 'connected' THEN 'Database Disconnected - persistence degraded' END,
    CASE WHEN ml <> 'loaded' THEN 'ML Model Unloaded - fraud scoring degraded' END], lambda m: m IS NOT NULL), '|') AS messages
FROM (SELECT user_id AS deployment, TIMESTAMP '2024-01-01' + to_milliseconds(event_id * 100) AS sample_at,
  CASE WHEN k <> 0 THEN 'running' ELSE 'down' END AS kafka,
  CASE WHEN k % 3 > 0 THEN 'active' WHEN k = 0 OR trunc(value * 10) > 2000 THEN 'down' ELSE 'idle' END AS spark,
  CASE WHEN k <> 1 THEN 'connected' ELSE 'disconnected' END AS db,
  CASE WHEN k <> 2 THEN 'loaded' ELSE 'unloaded' END AS ml FROM ev)""",
    "hour_windows": """
SELECT date_trunc('hour', created_at) AS window_start, count(*) AS total_jobs,
  count(*) FILTER (WHERE prediction = 1) AS fraud_jobs, count(*) FILTER (WHERE prediction = 1) / count(*) AS fraud_rate
FROM predictions GROUP BY 1""",
    "batch_stats": """
SELECT id // 700 AS batch_id, count(*) AS total_jobs, count(*) FILTER (WHERE prediction = 1) AS fraud_jobs,
  count(*) FILTER (WHERE prediction = 1) / count(*) AS fraud_rate FROM predictions GROUP BY 1""",
    "tokens": r"""
SELECT job_id, unnest(regexp_split_to_array(combined_text, '[^\p{L}\p{N}_]+')) AS term FROM texts""",
    "tf": "SELECT job_id, term, count(*) AS tf FROM tokens WHERE length(term) >= 2 GROUP BY job_id, term",
    "vocabulary": """
SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM texts)) / (1.0::DOUBLE + df)) + 1 AS idf FROM (
  SELECT term, sum(tf) AS uses, count(*) AS df FROM tf GROUP BY term)""",
    "weights": """
SELECT job_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY job_id)) AS weight
FROM (SELECT job_id, term, tf * idf AS w FROM tf JOIN vocabulary USING (term))""",
    "ranked": """
SELECT job_id, created_at, row_number() OVER (ORDER BY created_at, job_id) AS rank FROM postings""",
    "pair_scores": """
SELECT q.job_id, q.rank, c.rank AS match_rank, c.job_id AS match_job_id, round(sum(a.weight * b.weight), 9) AS similarity
FROM ranked q JOIN weights a ON a.job_id = q.job_id JOIN weights b ON b.term = a.term
JOIN ranked c ON c.job_id = b.job_id
WHERE c.rank < q.rank AND c.created_at >= q.created_at - INTERVAL 24 HOUR
GROUP BY ALL""",
    "matches": """
SELECT job_id, arg_max(match_job_id, (similarity, match_rank)) AS match_job_id, max(similarity) AS similarity
FROM pair_scores WHERE similarity >= 0.8::DOUBLE GROUP BY job_id""",
}


def ema(windows: str, order: str, carried: str) -> str:
    """Recursive walk over ``windows`` in order; ``carried`` are columns to keep."""
    count_bar = "greatest(8::DOUBLE, e.ema_count * 2.2::DOUBLE)"
    rate_bar = "greatest(0.55::DOUBLE, e.ema_rate * 1.8::DOUBLE)"
    digits = lambda x, n: (
        f"printf('%d.%0{n}d', CAST(floor(({x}) * {10**n}.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) // {10**n}, "
        f"CAST(floor(({x}) * {10**n}.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) % {10**n})"
    )
    many = f"'fraud_count_spike:' || n.fraud_jobs || '>=' || {digits(count_bar, 2)}"
    dense = f"'fraud_rate_spike:' || {digits('n.fraud_rate', 3)} || '>=' || {digits(rate_bar, 3)}"
    return f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM {windows}),
walk AS (
  SELECT i, {carried}, false AS is_anomaly, 'baseline_warmup' AS anomaly_reason,
    fraud_jobs::DOUBLE AS ema_count, fraud_rate::DOUBLE AS ema_rate FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.i, {", ".join("n." + c.strip() for c in carried.split(","))},
    (n.fraud_jobs >= {count_bar}) OR (n.fraud_rate >= {rate_bar} AND n.fraud_jobs >= 2),
    CASE WHEN n.fraud_jobs >= {count_bar} AND n.fraud_rate >= {rate_bar} AND n.fraud_jobs >= 2
      THEN {many} || '; ' || {dense}
    WHEN n.fraud_jobs >= {count_bar} THEN {many}
      WHEN n.fraud_rate >= {rate_bar} AND n.fraud_jobs >= 2 THEN {dense}
      ELSE 'normal_window' END,
    0.2::DOUBLE * n.fraud_jobs + (1 - 0.2::DOUBLE) * e.ema_count, 0.2::DOUBLE * n.fraud_rate + (1 - 0.2::DOUBLE) * e.ema_rate
  FROM walk e JOIN numbered n ON n.i = e.i + 1)"""


def with_ctes(body: str, extra: str = "") -> str:
    """Put the fragments a query names, and those they name, before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body + " " + extra)
    parts = [f"{name} AS ({CTES[name].strip()})" for name in needed]
    if extra:
        parts.append(extra.strip())
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
