"""The check queries: the same results written as SQL, from the given tables alone."""

from __future__ import annotations

from .fixture_sql import alert_columns, clean, ema, strip, with_ctes
from .registry import FRAMES

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, doubles: str = "", extra: str = "") -> None:
    """Register ``body``; columns in ``doubles`` are rounded to six places."""
    if doubles:
        swapped = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split())
        body = f"SELECT * REPLACE ({swapped}) FROM ({body.strip()}) AS rounded_rows"
    ORACLES[name] = with_ctes(body, extra)


_NOW = "2024-03-01T00:00:00+00:00"

oracle("normalize_posting", f"""
SELECT CASE WHEN doc_id % 2 = 0 THEN job_id ELSE 'j' || job_id END AS id, {strip("title")} AS title,
  {strip("CASE WHEN doc_id % 3 = 0 THEN description WHEN doc_id % 5 <> 0 THEN 'other text' ELSE '  ' END")} AS description,
  CASE WHEN company <> '' THEN company WHEN doc_id % 14 = 0 THEN 'Named Ltd' ELSE 'profile' END AS company,
  CASE WHEN doc_id % 4 = 0 THEN event_timestamp WHEN doc_id % 8 <> 1 THEN '2024-02-01' ELSE '{_NOW}' END AS "timestamp"
FROM postings""")
oracle("analyze_request_to_posting", f"""
SELECT job_id AS id, title,
  {strip(strip("description") + " || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'a degree' ELSE '' END")} AS description,
  CASE WHEN doc_id % 3 = 0 THEN 'info' WHEN doc_id % 5 <> 0 THEN 'profile' ELSE '' END AS company,
  '{_NOW}' AS "timestamp"
FROM postings""")
oracle("parse_posting_json", """
SELECT CASE WHEN ok THEN job_id ELSE '' END AS job_id, CASE WHEN ok THEN title ELSE '' END AS title,
  CASE WHEN ok THEN description ELSE '' END AS description, CASE WHEN ok THEN company ELSE '' END AS company,
  CASE WHEN ok THEN event_timestamp ELSE '' END AS event_timestamp, CAST(doc_id % 3 AS INTEGER) AS kafka_partition,
  doc_id AS kafka_offset, created_at AS kafka_timestamp, NOT ok AS is_malformed
FROM (SELECT *, doc_id % 10 <> 0 AS ok FROM postings)""")
oracle("read_postings_csv", f"""
SELECT job_id AS id, {strip("title")} AS title, {strip("description")} AS description, company,
  event_timestamp AS "timestamp" FROM postings WHERE {strip("title")} <> ''""")
oracle("read_training_csv", """
SELECT job_id, title, doc_id, CAST(quality AS DOUBLE) AS quality, fraudulent FROM training""")
oracle("read_postings_jsonl", f"""
SELECT job_id AS id, {strip("title")} AS title, {strip("description")} AS description, company,
  event_timestamp AS "timestamp" FROM postings WHERE {strip("title")} <> '' AND doc_id % 10 <> 0""")
oracle("ingest_rate_limit", """
SELECT least(total // 7 + 1, total - b * (total // 7 + 1)) AS n, b AS batch_id
FROM (SELECT count(*) AS total FROM postings), generate_series(0, 6) AS batches(b) WHERE b * (total // 7 + 1) < total""")
oracle("read_postings_stream", """
SELECT CASE WHEN ok THEN job_id ELSE '' END AS job_id, CASE WHEN ok THEN title ELSE '' END AS title,
  CASE WHEN ok THEN description ELSE '' END AS description, CASE WHEN ok THEN company ELSE '' END AS company,
  CASE WHEN ok THEN event_timestamp ELSE '' END AS event_timestamp, NOT ok AS is_malformed
FROM (SELECT *, doc_id % 10 <> 0 AS ok FROM postings)""")
oracle("new_predictions_since", """
SELECT id, job_id, prediction, confidence FROM predictions WHERE id > 100 ORDER BY id LIMIT 200""", "confidence")
oracle("latest_prediction_id", "SELECT coalesce(max(id), 0) AS latest_id FROM predictions")

oracle("publish_postings", f"""
SELECT job_id AS key, job_id AS id, {strip("title")} AS title, {strip("description")} AS description, company,
  event_timestamp AS "timestamp" FROM postings""")
oracle("sanitize_prediction", f"""
SELECT job_id, nullif({strip("title")}, '') AS title, prediction, confidence,
  CASE WHEN doc_id % 4 <> 0 THEN 'some reason' END AS reason, doc_id % 3 = 0 AS is_anomaly,
  CAST(NULL AS VARCHAR) AS anomaly_reason,
  CASE WHEN event_timestamp <> 'bad-time' THEN created_at END AS event_timestamp,
  CAST(NULL AS VARCHAR) AS cluster_id, 1 + CASE WHEN doc_id % 10 = 0 AND doc_id % 3 - 1 > 1 THEN 1 ELSE 0 END AS version,
  false AS is_corrected, original_score, CAST(NULL AS VARCHAR) AS correction_reason,
  {strip("combined_text")} AS text_blob, updated_score,
  CASE WHEN updated_score > 0 THEN updated_score ELSE original_score END AS risk_score
FROM (SELECT *, CASE WHEN doc_id % 8 = 0 THEN 0.0::DOUBLE WHEN doc_id % 8 = 1 THEN 1.0::DOUBLE
    ELSE original_score END AS updated_score
  FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN least(1, doc_id % 7 / 5.0::DOUBLE)
      WHEN prediction = 1 THEN confidence ELSE 1 - confidence END AS original_score
    FROM (SELECT * EXCLUDE (prediction, confidence),
        CASE WHEN doc_id % 6 = 0 THEN 0 ELSE CAST(doc_id % 2 AS INTEGER) END AS prediction,
        CASE WHEN doc_id % 9 = 0 THEN 0 ELSE least(1, doc_id % 13 / 10.0::DOUBLE) END AS confidence,
      FROM scored s JOIN (SELECT job_id, created_at FROM postings) p USING (job_id))))""",
       "confidence original_score updated_score risk_score")
oracle("write_predictions", """
SELECT id // 700 AS batch_id, count(*) AS n, sum(confidence) AS confidence FROM predictions GROUP BY 1""", "confidence")
oracle("write_batch_metrics", """
SELECT batch_id, CAST(jobs_received AS INTEGER) AS jobs_received, CAST(jobs_failed AS INTEGER) AS jobs_failed,
  0.0::DOUBLE AS throughput_jobs_per_sec, error_rate, 'spark_stream' AS source FROM metrics""",
       "throughput_jobs_per_sec error_rate")
oracle("write_dead_letters", r"""
SELECT job_id, title, 0 AS prediction, confidence, nullif(trim(reason), '') AS reason, job_id AS payload_json,
  greatest(0, attempts - 2) AS retry_count, coalesce(nullif(failure_stage, ''), 'unknown_stage') AS failure_stage,
  coalesce(nullif(failure_reason, ''), 'unknown_failure') AS failure_reason, 'spark_stream' AS source FROM queue""",
       "confidence")
oracle("processed_event", """
SELECT job_id AS id, title, prediction, coalesce(confidence, 0) AS c, tags AS reason, risk AS risk_score,
  surge AS is_anomaly, CASE WHEN surge THEN batch_anomaly_reason END AS anomaly_reason, event_timestamp AS "timestamp"
FROM records""".replace("coalesce(confidence, 0) AS c", "least(1, greatest(0, coalesce(confidence, 0))) AS confidence"),
       "confidence risk_score")
oracle("emit_corrections", """
SELECT job_id, old_score, new_score, new_reason AS reason, correction_type, as_of AS updated_at FROM corrected, clock""",
       "old_score new_score")
_CLOSED = "window_start + INTERVAL 1 HOUR <= as_of - INTERVAL 1 HOUR"
oracle("window_metrics_sink", "SELECT * FROM hour_windows", "fraud_rate")
oracle("upgrade_predictions", """
SELECT job_id, prediction, 1 AS version, false AS is_corrected, original_score, updated_score,
  updated_score AS risk_score, is_anomaly
FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 0.25::DOUBLE ELSE original_score END AS updated_score,
    doc_id % 4 = 0 AS is_anomaly
  FROM (SELECT *, CASE WHEN prediction = 1 THEN coalesce(confidence, 0)
    ELSE greatest(0, 1 - coalesce(confidence, 0)) END AS original_score FROM scored))""",
       "original_score updated_score risk_score")
oracle("upgrade_corrections", """
SELECT job_id, old_score, new_score, updated_at,
  CASE WHEN new_score >= 0.9::DOUBLE THEN correction_type ELSE 'RISK_INCREASE' END AS correction_type FROM history""",
       "old_score new_score")

oracle("combined_text", "SELECT job_id, combined_text FROM texts")
oracle("event_time", """
SELECT job_id, CASE WHEN event_timestamp <> 'bad-time' THEN created_at END AS event_time FROM postings""")
oracle("fill_missing_text", """
SELECT job_id, coalesce(title, '') AS title, coalesce(company_profile, '') AS company_profile,
  coalesce(requirements, '') AS requirements FROM training""")
oracle("impute_median", """
SELECT job_id, coalesce(quality, (SELECT median(quality) FROM training)) AS quality,
  coalesce(length, (SELECT median(length) FROM training)) AS length, 0.0::DOUBLE AS nothing FROM training""",
       "quality length nothing")
oracle("clean_text", f"SELECT job_id, {clean('description')} AS cleaned FROM postings")
oracle("training_text", "SELECT job_id, combined_text FROM training_texts")
oracle("posting_numbers", """
SELECT job_id, CASE WHEN trim(coalesce(company_profile, '')) <> '' THEN 1 ELSE 0 END AS has_company_profile,
  CASE WHEN salary_range IS NOT NULL THEN 1 ELSE 0 END AS has_salary_range,
  CAST(length(combined_text) AS INTEGER) AS text_length FROM training_texts""")
oracle("assemble_features", """
SELECT job_id, CASE WHEN trim(coalesce(company_profile, '')) <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS profile,
  CASE WHEN salary_range IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS salary, length(combined_text)::DOUBLE AS length
FROM training_texts""")
oracle("train_test_split", """
SELECT job_id, CASE WHEN ('0x' || substr(md5(job_id || '|42'), 1, 8))::BIGINT % 10000 < 8000 THEN 'train' ELSE 'test' END AS part
FROM training""")
oracle("serve_time_features", f"""
SELECT job_id, CASE WHEN {strip('combined_text')} <> '' THEN 1 ELSE 0 END AS has_company_profile,
  CASE WHEN regexp_matches(combined_text, '[0-9]') THEN 1 ELSE 0 END AS has_salary_range,
  CAST(length({strip('combined_text')}) AS INTEGER) AS text_length FROM texts""")
oracle("posting_reason", "SELECT job_id, reason FROM tagged")
oracle("keyword_hits", "SELECT job_id, array_to_string(hits, '|') AS hits FROM tagged")
oracle("suspicious_keywords", """
SELECT job_id, array_to_string(hits, ',') AS suspicious_keywords, trim(combined_text) <> '' AS is_scorable FROM tagged""")
oracle("domain_pattern", "SELECT job_id, domain_pattern FROM tagged")
oracle("base_score", "SELECT job_id, base AS base_score FROM tagged", "base_score")
oracle("risk_score", "SELECT job_id, risk AS risk_score FROM records", "risk_score")
oracle("reason_tags", "SELECT job_id, tags AS reason_tags FROM records")
oracle("scored_record", """
SELECT job_id, title, prediction, least(1, greatest(0, coalesce(confidence, 0))) AS confidence, reason, tags AS reason_tags,
  risk AS risk_score, surge AS is_anomaly, CASE WHEN surge THEN batch_anomaly_reason END AS anomaly_reason,
  base AS original_score, risk AS updated_score, combined_text, event_timestamp,
  array_to_string(hits, ',') AS suspicious_keywords, domain_pattern, kafka_partition, kafka_offset FROM records""",
       "confidence risk_score original_score updated_score")
oracle("event_latency_ms", """
SELECT job_id, CASE WHEN event_timestamp <> 'bad-time'
  THEN greatest(0, (epoch_us(TIMESTAMP '2024-01-03') - epoch_us(created_at)) / 1000.0::DOUBLE) END AS latency_ms
FROM postings""", "latency_ms")
oracle("prediction_label", """
SELECT event_id, CASE WHEN k % 3 = 0 THEN 'FAKE' WHEN k % 3 = 2 AND k % 2 = 1 THEN 'FAKE' ELSE 'REAL' END AS label FROM ev""")
oracle("serve_prediction", """
SELECT CAST(v.id AS VARCHAR) AS id, v.job_id, v.title, CASE WHEN v.prediction = 1 THEN 'FAKE' ELSE 'REAL' END AS label,
  v.confidence, CASE WHEN v.updated_score > 0 THEN v.updated_score
    WHEN v.prediction = 1 THEN v.confidence ELSE 1 - v.confidence END AS risk_score,
  v.reason, array_to_string(list_filter([p.reason, v.domain_pattern], lambda t: trim(t) <> ''), '|') AS reason_tags,
  v.is_anomaly, v.anomaly_reason, v.suspicious_keywords, v.domain_pattern, v.cluster_id, v.version, v.is_corrected,
  v.original_score, v.updated_score, v.correction_reason, v.event_timestamp, p.k * 1000.0::DOUBLE AS latency_ms, v.created_at
FROM versions v JOIN predictions p ON p.job_id = v.job_id""",
       "confidence risk_score original_score updated_score latency_ms")
oracle("normalize_unit", """
SELECT event_id, CASE WHEN k % 4 = 0 THEN 0 WHEN value > 1 THEN least(1, value / 100) ELSE value END AS unit FROM ev""",
       "unit")
oracle("normalize_corrections", """
SELECT job_id, 'Untitled Posting' AS job_title, cluster_id,
  CASE WHEN new_score >= 0.6::DOUBLE THEN correction_type WHEN new_score * 1.1::DOUBLE >= 0.8::DOUBLE
    THEN 'UPGRADE_TO_FRAUD' ELSE 'RISK_INCREASE' END AS correction_type,
  old_score, least(1, new_score * 1.1::DOUBLE) AS new_score, updated_at FROM history""", "old_score new_score")
oracle("fraud_only", "SELECT id, job_id, confidence FROM predictions WHERE prediction = 1", "confidence")
oracle("job_id_prefix_count", "SELECT count(*) AS n FROM predictions WHERE job_id LIKE 'job-1%'")

oracle("tfidf_weights", "SELECT job_id, term, weight FROM weights", "weight")
oracle("evaluate", """
SELECT tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive,
  (tn + tp) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision",
  coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE NOT g AND NOT t) AS tn, count(*) FILTER (WHERE g AND NOT t) AS fp,
  count(*) FILTER (WHERE NOT g AND t) AS fn, count(*) FILTER (WHERE g AND t) AS tp
  FROM (SELECT event_type = 'error' AS g, k >= 50 AS t FROM ev))""", 'accuracy "precision" recall f1')

oracle("corrections_with_jobs", "SELECT * FROM history_jobs", "old_score new_score")
oracle("correction_targets", """
SELECT job_id, cluster_id, count_24h, pressure_score FROM predictions JOIN pressure USING (cluster_id)""", "pressure_score")
oracle("similar_prior_postings", "SELECT job_id, match_job_id, similarity FROM matches", "similarity")
oracle("best_match", """
SELECT job_id, arg_max(match_job_id, (similarity, match_time)) AS match_job_id, max(similarity) AS similarity FROM (
  SELECT e.event_id AS job_id, o.event_id AS match_job_id, (e.k * (e.i - o.i)) % 10 / 10.0::DOUBLE AS similarity,
    o.ts AS match_time
  FROM numbered e JOIN numbered o ON e.user_id = o.user_id AND e.i - o.i BETWEEN 1 AND 3)
GROUP BY job_id""", "similarity",
       "numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM ev)")
oracle("assign_clusters", """
SELECT w.job_id, 'cluster_' || sha256(t.combined_text) AS cluster_id
FROM walk w JOIN (SELECT job_id, trim_text AS combined_text FROM trimmed) t ON t.job_id = w.root_id""",
       extra=f"""
links AS (SELECT p.job_id, m.match_job_id AS parent_id FROM postings p LEFT JOIN matches m ON m.job_id = p.job_id),
trimmed AS (SELECT job_id, {strip('combined_text')} AS trim_text FROM texts),
walk AS (SELECT job_id, job_id AS root_id FROM links WHERE parent_id IS NULL
  UNION ALL SELECT l.job_id, w.root_id FROM walk w JOIN links l ON l.parent_id = w.job_id)""")
oracle("cluster_memberships", "SELECT cluster_id, job_id, created_at FROM members")
oracle("cluster_pressure", "SELECT * FROM pressure", "pressure_score")
oracle("pressure_at_insert", "SELECT m.job_id, timeline.* FROM members m JOIN timeline USING (cluster_id, created_at)",
       "pressure_score")
oracle("high_pressure_clusters", """
SELECT count(*) AS high_pressure_clusters FROM (SELECT cluster_id FROM members, clock
  WHERE created_at BETWEEN as_of - INTERVAL 24 HOUR AND as_of GROUP BY cluster_id HAVING ln(count(*) + 1) > 1)""")
oracle("apply_corrections", """
SELECT job_id, CASE WHEN pressure_score > 2 THEN 1 ELSE prediction END AS prediction,
  CASE WHEN correction_type = 'UPGRADE_TO_FRAUD' THEN 'UPDATED FRAUD DETECTION: ' ELSE 'UPDATED RISK ESCALATION: ' END
    || flat AS reason, 2 AS version, true AS is_corrected, new_score AS updated_score, new_reason AS correction_reason,
  old_score, correction_type FROM corrected""", "updated_score old_score")
oracle("correction_history", "SELECT * FROM history", "old_score new_score")

oracle("batch_fraud_stats", "SELECT * FROM batch_stats", "fraud_rate")
oracle("batch_metrics", """
SELECT batch_id, batch_started_at, batch_completed_at, jobs_received, jobs_inserted, jobs_failed, spark_batch_time_ms,
  db_insert_time_ms, throughput_jobs_per_sec, avg_latency_ms, error_rate, fraud_rate, anomaly_rate,
  'spark_stream' AS source FROM metrics""",
       "spark_batch_time_ms db_insert_time_ms throughput_jobs_per_sec avg_latency_ms error_rate fraud_rate anomaly_rate")
oracle("dashboard_metrics", "SELECT * FROM dashboard", "fake_percentage throughput avg_confidence processing_latency_ms")
oracle("hourly_trends", "SELECT * FROM trends", "throughput")
oracle("fill_hours", """
SELECT s.bucket_start, count(p.id) AS total FROM spine s CROSS JOIN clock c LEFT JOIN predictions p
  ON date_trunc('hour', p.created_at) = s.bucket_start AND p.created_at BETWEEN c.as_of - INTERVAL 24 HOUR AND c.as_of
GROUP BY 1""")
oracle("cluster_spikes", "SELECT * FROM spikes")
oracle("spike_pressure", "SELECT *, cluster_jobs + corrections AS pressure FROM spikes")
oracle("top_clusters", "SELECT * FROM top", "pressure_score peak_score")
oracle("system_metrics", "SELECT * FROM system",
       "throughput_jobs_per_sec avg_latency_ms error_rate fraud_rate anomaly_rate spark_batch_time_ms db_insert_time_ms")
oracle("recent_activity", """
SELECT count(*) AS recent_jobs FROM predictions, clock WHERE created_at BETWEEN as_of - INTERVAL 60 MINUTE AND as_of""")
oracle("stats", """
SELECT total_jobs, fake_jobs, real_jobs, fake_percentage, corrected_jobs, high_pressure_clusters, error_rate, fraud_rate, anomaly_rate
FROM dashboard, (SELECT coalesce(avg(error_rate), 0) AS error_rate FROM metrics, clock
    WHERE created_at BETWEEN as_of - INTERVAL 5 MINUTE AND as_of),
  (SELECT count(*) FILTER (WHERE prediction = 1) / count(*) AS fraud_rate,
    count(*) FILTER (WHERE is_anomaly) / count(*) AS anomaly_rate
   FROM versions, clock WHERE created_at BETWEEN as_of - INTERVAL 5 MINUTE AND as_of)""",
       "fake_percentage error_rate fraud_rate anomaly_rate")
oracle("stream_lag", "SELECT CAST(sum(greatest(0, end_offset - next_offset)) AS BIGINT) AS lag FROM ends")
oracle("group_lag", """
SELECT CAST(sum(greatest(0, end_offset - (end_offset - 3 * p - 1))) AS BIGINT) AS lag FROM ends WHERE p <> 2""")
oracle("load_summary", """
SELECT n AS total_sent, good AS succeeded, n - good AS failures, round(mean, 3) AS avg_latency,
  round(top, 3) AS max_latency, round(good / greatest(0.001, secs), 3) AS throughput_jobs_per_sec,
  round((n - good) / greatest(n, 1), 6) AS error_rate
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS good,
  avg(value) FILTER (WHERE event_type <> 'error') AS mean, max(value) FILTER (WHERE event_type <> 'error') AS top,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS secs FROM events)""",
       "avg_latency max_latency throughput_jobs_per_sec error_rate")
_REASON = "coalesce(nullif(trim(reason), ''), 'Unknown reason')"
_STOP = "('and','the','for','with','from','that','this','job','posting','model','flagged','fraud','risk','high','low','detected')"
oracle("reason_distribution", f"""
SELECT {strip(_REASON)} AS reason, count(*) AS "count" FROM alert_rows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")


def _words(text: str) -> str:
    return f"""(SELECT keyword, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower({text}), '[^a-z0-9]+')) AS keyword
  FROM alert_rows) WHERE length(keyword) > 2 AND keyword NOT IN {_STOP} GROUP BY keyword)"""


oracle("top_keywords", f"""
SELECT keyword, n AS "count" FROM {_words("job_title || ' ' || reason")} ORDER BY n DESC, keyword LIMIT 8""")
oracle("confidence_histogram", """
SELECT CAST(b.bin AS INTEGER) AS bin, count(a.id) AS "count"
FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN alert_rows a ON least(9, floor(a.risk_score * 10)) = b.bin GROUP BY b.bin""")
oracle("category_counts", 'SELECT category, count(*) AS "count" FROM alert_titles GROUP BY category')
oracle("alert_intelligence", f"""
SELECT (SELECT category FROM alert_titles GROUP BY category ORDER BY count(*) DESC, category LIMIT 1) AS highest_fraud_category,
  (SELECT {_REASON} FROM alert_rows GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS common_fraud_reason,
  (SELECT keyword || ' +' || n FROM {_words("reason")} ORDER BY n DESC, keyword LIMIT 1) AS suspicious_keyword_spike,
  (SELECT round(avg(confidence) * 1000) / 10 FROM predictions) AS model_confidence""", "model_confidence")
oracle("minute_of_day_trends", """
SELECT strftime(created_at, '%H:%M') AS "timestamp", count(*) AS total_jobs, count(*) FILTER (WHERE prediction = 1) AS fake_jobs,
  count(*) FILTER (WHERE prediction <> 1) AS real_jobs, count(*) / 3600 AS throughput
FROM (SELECT * FROM predictions ORDER BY created_at DESC, id DESC LIMIT 200) GROUP BY 1""", "throughput")
oracle("critical_count", "SELECT count(*) AS critical_alerts FROM alert_marks WHERE severity = 'critical'")
oracle("alert_categories", "SELECT DISTINCT category FROM alert_marks")
_NEWEST = "(SELECT * FROM history_jobs ORDER BY updated_at DESC, job_id LIMIT 35)"
oracle("correction_event_summary", f"""
SELECT cluster_id, count(*) AS "count", max(updated_at) AS latest_at FROM {_NEWEST} GROUP BY 1 HAVING count(*) >= 3""")
oracle("peak_throughput", """
SELECT greatest((SELECT max(throughput) FROM trends),
  (SELECT round(count(*) FILTER (WHERE created_at BETWEEN as_of - INTERVAL 1 MINUTE AND as_of) / 60, 2) FROM predictions, clock)) AS peak_throughput""",
       "peak_throughput")

oracle("metric_delta", """
SELECT round((a - greatest(1, b)) / greatest(1, b) * 100, 1) AS delta FROM (
  SELECT total_jobs AS a, lag(total_jobs) OVER (ORDER BY bucket_start) AS b, bucket_start FROM trends)
ORDER BY bucket_start DESC LIMIT 1""", "delta")
oracle("fake_rate_series", """
SELECT bucket_start, "timestamp", round(fake_jobs / greatest(total_jobs, 1) * 100, 1) AS fake_rate FROM trends""", "fake_rate")
oracle("rolling_history", """
SELECT bucket_start, array_to_string(list(total_jobs) OVER (ORDER BY bucket_start ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), '|')
  AS history FROM trends""")
oracle("cluster_heatmap", """
SELECT *, jobs_24h / greatest(max(jobs_24h) OVER (), 1) AS size_intensity,
  greatest(peak_score, corrected_jobs / greatest(jobs_24h, 1)) AS fraud_intensity,
  least(1, 2 * CASE WHEN jobs_6h > 0 THEN jobs_1h / jobs_6h WHEN jobs_1h > 0 THEN 1 ELSE 0 END) AS growth_intensity,
  CAST(round(100 * CASE WHEN jobs_6h > 0 THEN jobs_1h / jobs_6h WHEN jobs_1h > 0 THEN 1 ELSE 0 END) AS INTEGER) AS growth_percent
FROM (SELECT * FROM top ORDER BY pressure_score DESC, corrected_jobs DESC, jobs_24h DESC, cluster_id LIMIT 6)""",
       "pressure_score peak_score size_intensity fraud_intensity growth_intensity")
oracle("replay_schedule", """
SELECT job_id, doc_id, delay_s, sum(delay_s) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS release_s
FROM (SELECT *, coalesce(least(2, greatest(0, (us - before) / 1e6) / 90), 0) AS delay_s
  FROM (SELECT *, last_value(us IGNORE NULLS) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM (SELECT *, CASE WHEN event_timestamp <> 'bad-time' THEN epoch_us(created_at) END AS us FROM postings)))""",
       "delay_s release_s")

oracle("latest_jobs", "SELECT id, job_id, title, created_at FROM predictions ORDER BY created_at DESC, id DESC LIMIT 50")
oracle("fake_jobs", """
SELECT id, job_id, title, created_at FROM predictions WHERE prediction = 1 ORDER BY created_at DESC, id DESC LIMIT 100""")
_ALERT_SCORE = "CASE WHEN updated_score > 0 THEN least(1, greatest(0, updated_score)) ELSE confidence END"
oracle("alerts", f"""
SELECT {alert_columns(_ALERT_SCORE, 'Fraud escalation detected: cluster risk threshold exceeded')}
FROM (SELECT * FROM versions WHERE prediction = 1 ORDER BY updated_score DESC, created_at DESC, id DESC LIMIT 25)""",
       "risk risk_score")
oracle("recent_corrections", """
SELECT job_id, cluster_id, old_score, new_score, correction_type, updated_at, CAST(position AS INTEGER) AS position,
  position = coalesce(min(CASE WHEN position <= 8 AND correction_type = 'UPGRADE_TO_FRAUD' THEN position END) OVER (), 1) AS is_featured
FROM (SELECT *, row_number() OVER (ORDER BY updated_at DESC, job_id) AS position FROM history)
WHERE position <= 50""", "old_score new_score")
oracle("alert_view", """
SELECT * EXCLUDE (correction_reason) FROM alert_marks WHERE severity = 'critical'""", "risk risk_score")
oracle("merge_alerts", """
SELECT id, job_title, risk_score, reason, CASE WHEN risk_score > 0.1::DOUBLE THEN "timestamp" - INTERVAL 1 HOUR
    ELSE "timestamp" END AS "timestamp", CASE WHEN risk_score > 0.1::DOUBLE THEN 'critical' ELSE level END AS level
FROM alert_rows ORDER BY 5 DESC, risk_score DESC, id DESC LIMIT 50""", "risk_score")
_STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"
oracle("live_fraud_feed", f"""
SELECT * FROM (
  SELECT 'event-job-' || job_id || '-' || {_STAMP.format('updated_at')} AS id, updated_at AS "timestamp",
    CASE WHEN correction_type = 'UPGRADE_TO_FRAUD' THEN 'Job upgraded to FRAUD (' || cluster_id || ')'
      ELSE 'Risk increase applied for ' || job_title END AS message,
    CASE WHEN correction_type = 'UPGRADE_TO_FRAUD' THEN 'critical' ELSE 'warning' END AS tone
  FROM {_NEWEST}
  UNION ALL
  SELECT 'event-cluster-' || cluster_id || '-' || {_STAMP.format('max(updated_at)')}, max(updated_at),
    count(*) || ' jobs corrected in ' || cluster_id, 'critical' FROM {_NEWEST} GROUP BY cluster_id HAVING count(*) >= 3
  UNION ALL
  SELECT * FROM (SELECT 'event-pattern-' || job_id || '-' || {_STAMP.format('updated_at')}, updated_at,
    'High-risk pattern detected in ' || cluster_id, 'warning' FROM {_NEWEST} WHERE new_score >= 0.9::DOUBLE
    ORDER BY updated_at DESC, job_id LIMIT 1))
ORDER BY "timestamp" DESC, id LIMIT 20""")

oracle("alert_level", """
SELECT id, CASE WHEN is_corrected OR round(updated_score * 100, 2) >= 90 THEN 'critical'
    WHEN round(updated_score * 100, 2) >= 75 THEN 'warning' ELSE 'info' END AS level,
  CASE WHEN round(original_score * 100, 2) >= 90 THEN 'critical'
    WHEN round(original_score * 100, 2) >= 75 THEN 'warning' ELSE 'info' END AS plain_level FROM versions""")
oracle("alert_severity", "SELECT id, severity FROM alert_marks")
oracle("alert_reason", """
SELECT id, CASE WHEN is_corrected THEN 'UPDATED FRAUD DETECTION: ' || correction_reason
  ELSE reason END AS reason FROM versions""")
oracle("alert_from_prediction", "SELECT * FROM alert_rows", "risk risk_score")
oracle("alert_category", "SELECT id, category FROM alert_marks")
oracle("job_category", """
SELECT id, CASE WHEN contains(title, 'remote') THEN 'Remote' WHEN contains(title, 'developer') THEN 'Engineering'
  WHEN contains(title, 'analyst') THEN 'Data' WHEN contains(title, 'lead') THEN 'Management'
  WHEN contains(title, 'designer') THEN 'Design' ELSE 'General' END AS category FROM predictions""")
oracle("score_status", """
SELECT id, CASE WHEN updated_score >= 0.75::DOUBLE THEN 'FRAUD' ELSE 'SAFE' END AS status,
  CASE WHEN is_corrected OR updated_score >= 0.75::DOUBLE THEN 'FRAUD' ELSE 'SAFE' END AS forced_status FROM versions""")
oracle("health_status", "SELECT deployment, sample_at, kafka, spark, db, ml, messages, messages <> '' AS degraded FROM health")
oracle("system_mode", """
SELECT deployment, sample_at, mode,
  CASE WHEN mode = 'recovery' THEN 'Recovery Mode - reconnecting services and validating stream health' ELSE messages END AS messages,
  mode <> 'normal' AS degraded FROM walk""", extra="""
numbered AS (SELECT *, row_number() OVER (PARTITION BY deployment ORDER BY sample_at) AS i FROM health),
walk AS (
  SELECT deployment, sample_at, i, messages, CASE WHEN messages <> '' THEN 'degraded' ELSE 'normal' END AS mode,
    sample_at AS changed FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.deployment, n.sample_at, n.i, n.messages,
    CASE WHEN n.messages <> '' THEN 'degraded' WHEN w.mode = 'degraded' THEN 'recovery'
      WHEN w.mode = 'recovery' AND n.sample_at - w.changed > INTERVAL 30 SECOND THEN 'normal' ELSE w.mode END,
    CASE WHEN n.messages <> '' AND w.mode <> 'degraded' THEN n.sample_at
      WHEN n.messages = '' AND w.mode = 'degraded' THEN n.sample_at
      WHEN n.messages = '' AND w.mode = 'recovery' AND n.sample_at - w.changed > INTERVAL 30 SECOND THEN n.sample_at
      ELSE w.changed END
  FROM walk w JOIN numbered n ON n.deployment = w.deployment AND n.i = w.i + 1)""")
oracle("bucket_label", "SELECT id, strftime(created_at, '%H:%M') AS label FROM predictions")

oracle("fraud_windows", """
SELECT date_trunc('minute', created_at) AS window_start, count(*) AS total_jobs,
  count(*) FILTER (WHERE prediction = 1) AS fraud_jobs, count(*) FILTER (WHERE prediction = 1) / count(*) AS fraud_rate
FROM predictions GROUP BY 1""", "fraud_rate")
_HOURLY = ema("hour_windows", "window_start", "window_start, total_jobs, fraud_jobs, fraud_rate")
oracle("ema_anomaly", "SELECT * EXCLUDE (i) FROM walk", "fraud_rate ema_count ema_rate", _HOURLY)
oracle("ema_baseline", "SELECT window_start, ema_count, ema_rate FROM walk", "ema_count ema_rate", _HOURLY)
oracle("stream_ema_anomaly", f"SELECT walk.* EXCLUDE (i) FROM walk, clock WHERE {_CLOSED}",
       "fraud_rate ema_count ema_rate", _HOURLY)
oracle("tag_batch_anomaly", """
SELECT p.job_id, w.batch_id, w.is_anomaly AS batch_is_anomaly, w.anomaly_reason AS batch_anomaly_reason
FROM predictions p JOIN walk w ON w.batch_id = p.id // 700""",
       extra=ema("batch_stats", "batch_id", "batch_id"))
oracle("retry_plan", """
SELECT job_id, attempts + 1 AS attempts,
  CASE WHEN attempts + 1 < 8 THEN TIMESTAMP '2024-02-01' + to_seconds(CAST(least(pow(2, attempts + 1), 60) AS BIGINT)) END AS next_retry_at,
  CASE WHEN attempts + 1 < 8 THEN '' ELSE coalesce(nullif(failure_stage, ''), 'db_retry') END AS stage,
  CASE WHEN attempts + 1 < 8 THEN '' ELSE coalesce(last_error, nullif(failure_reason, ''), 'max_retries_exceeded') END AS reason
FROM queue""")
_DUE = "(SELECT * FROM queue WHERE next_retry_at <= TIMESTAMP '2024-01-20' ORDER BY queued_at, job_id LIMIT 200)"
oracle("due_retries", f"SELECT job_id, queued_at, next_retry_at FROM {_DUE} AS due_rows")
oracle("cap_backlog", """
SELECT job_id, CASE WHEN row_number() OVER (ORDER BY queued_at DESC, job_id DESC) <= 500 THEN 'queue'
  ELSE 'retry_backlog_overflow' END AS place FROM queue""")
oracle("retry_pass", f"""
SELECT q.job_id, CASE WHEN d.job_id IS NULL THEN 'queue' WHEN q.confidence < 0.1::DOUBLE THEN 'stored'
  WHEN q.attempts + 1 >= 8 THEN 'dead' ELSE 'queue' END AS place
FROM queue q LEFT JOIN {_DUE} d ON d.job_id = q.job_id""")
oracle("live_counters", """
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE prediction = 1) AS fake_jobs,
  count(*) FILTER (WHERE prediction <> 1) AS real_jobs, count(*) FILTER (WHERE prediction = 1) * 100.0::DOUBLE / count(*) AS fake_percentage,
  max(created_at) AS last_processed_at FROM predictions""", "fake_percentage")
oracle("alert_stream", "SELECT * FROM alert_rows", "risk risk_score")


def _snapshot() -> str:
    """Every figure of every frame, from the checks of the frames themselves."""
    parts = []
    twins = {"metrics": "dashboard_metrics", "corrections": "corrections_with_jobs", "trends": "hourly_trends"}
    for name, (key, figures) in FRAMES.items():
        twin = twins.get(name, name)
        item = "strftime(bucket_start, '%Y-%m-%d %H:%M:%S')" if key == "bucket_start" else key or "''"
        rows = " UNION ALL ".join(
            f"SELECT '{name}' AS frame, CAST({item} AS VARCHAR) AS item, '{c}' AS figure, "
            f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS value FROM {name}_rows"
            for c in figures.split()
        )
        parts.append(f"SELECT * FROM (WITH {name}_rows AS MATERIALIZED ({ORACLES[twin]}) {rows})")
    return " UNION ALL ".join(parts)


ORACLES["snapshot"] = _snapshot()
