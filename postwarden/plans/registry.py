"""Every operator as a named query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.scalars import ntz
from ..operators import alerts as al
from ..operators import anomaly as an
from ..operators import features as fe
from ..operators import health as he
from ..operators import insights as ins
from ..operators import metrics as me
from ..operators import model as mo
from ..operators import pressure as pr
from ..operators import records as re_
from ..operators import replay as rp
from ..operators import retry as rt
from ..operators import rules as ru
from ..operators import similarity as si
from ..operators import trends as tr
from ..operators import vectors as ve
from ..session import bounded_listing, cut_lineage, scratch_path, use_utc
from ..sinks import tables as sk
from ..sources import feed as fd
from ..sources import postings as so
from ..streaming import messages as ms
from ..streaming import pipeline as st
from ..streaming import source as ss
from ..streaming import windows as sw
from ..streaming.tables import Tables
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_DOUBLE = ("double", "float")


def query(fn: Query) -> Query:
    """Register ``fn`` under its name; doubles are rounded so that the order of a
    sum does not show."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        bounded_listing(use_utc(spark))
        return rounded(fn(spark, sf))

    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places, times without zone."""
    columns = {}
    for name, kind in df.dtypes:
        if kind in _DOUBLE:
            columns[name] = F.round(name, digits) + F.lit(0.0)
        elif kind == "timestamp":
            columns[name] = ntz(name)
    return df.withColumns(columns) if columns else df


def joined(df: DataFrame, *names: str) -> DataFrame:
    """Arrays of text as one text."""
    return df.withColumns({n: F.array_join(n, "|") for n in names})


# ---- sources


@query
def normalize_posting(spark, sf):
    d, blank = F.col("doc_id"), F.lit("")
    raw = fx.postings(spark, sf).select(
        F.when(d % 2 == 0, F.concat(F.lit(" "), "job_id")).otherwise(blank).alias("id"),
        F.concat(F.lit("j"), "job_id").alias("job_id"),
        F.concat(F.lit("  "), "title", F.lit(" ")).alias("title"),
        F.when(d % 3 == 0, F.col("description")).when(d % 3 == 1, blank).alias("description"),
        F.when(d % 5 != 0, F.lit("other text")).otherwise(F.lit("  ")).alias("job_description"),
        F.lit("needs a degree").alias("requirements"),
        F.nullif(F.col("company"), blank).alias("company"),
        F.when(d % 14 == 0, F.lit("Named Ltd")).alias("company_name"),
        F.lit("profile").alias("company_profile"),
        F.when(d % 4 == 0, F.col("event_timestamp")).alias("timestamp"),
        F.when(d % 8 != 1, F.lit("2024-02-01")).alias("created_at"),
    )
    return so.normalize_posting(raw, "2024-03-01T00:00:00+00:00")


@query
def analyze_request_to_posting(spark, sf):
    d = F.col("doc_id")
    raw = fx.postings(spark, sf).select(
        F.col("job_id").alias("id"),
        "title",
        F.concat(F.lit(" "), "description").alias("description"),
        F.when(d % 2 == 0, F.lit("a degree ")).otherwise(F.lit("")).alias("requirements"),
        F.when(d % 3 == 0, F.lit(" info ")).alias("company_info"),
        F.when(d % 5 != 0, F.lit("profile")).alias("company_profile"),
    )
    return so.analyze_request_to_posting(raw, "2024-03-01T00:00:00+00:00")


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    posting = F.to_json(
        F.struct(
            F.col("job_id").alias("id"), "title", "description",
            F.nullif(F.col("company"), F.lit("")).alias("company"),
            F.col("event_timestamp").alias("timestamp"),
        )
    )
    return fx.postings(spark, sf).select(
        F.when(d % 10 == 0, F.lit("no json")).otherwise(posting).alias("value"),
        (d % 3).alias("partition"),
        d.alias("offset"),
        F.col("created_at").alias("timestamp"),
    )


@query
def parse_posting_json(spark, sf):
    return ss.parse_posting_json(_messages(spark, sf)).drop("raw_value")


@query
def read_postings_csv(spark, sf):
    path = scratch_path(spark)
    rows = fx.postings(spark, sf).select("job_id", "title", "description", "company", "event_timestamp")
    rows = rows.withColumnRenamed("event_timestamp", "timestamp").withColumnRenamed("job_id", "id")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return so.read_postings_csv(spark, path)


@query
def read_training_csv(spark, sf):
    path = scratch_path(spark)
    rows = fx.training(spark, sf).drop("nothing", "length")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    read = so.read_training_csv(spark, path, ("doc_id", "quality", "fraudulent"))
    return read.select("job_id", "title", F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "fraudulent")


@query
def read_postings_jsonl(spark, sf):
    path = scratch_path(spark)
    lines = _messages(spark, sf).select("value")
    lines.write.text(path)
    return so.read_postings_jsonl(spark, path)


@query
def read_postings_stream(spark, sf):
    path = scratch_path(spark)
    _messages(spark, sf).select("value").write.text(f"{path}/in")
    stream = ss.read_postings_stream(spark, "text", f"{path}/in", maxFilesPerTrigger="100")
    rows = stream.select("job_id", "title", "description", "company", "event_timestamp", "is_malformed")
    _to_files(rows, path)
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def _to_files(df: DataFrame, path: str) -> None:
    """Run a stream over all there is and append the result to files."""
    writer = df.writeStream.format("parquet").option("path", f"{path}/out")
    writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@query
def ingest_rate_limit(spark, sf):
    """The messages of each trigger under a limit of a seventh of them."""
    path = scratch_path(spark)
    rows = _messages(spark, sf).select(F.col("offset").cast("string").alias("key"), "value", F.col("offset").alias("order"))
    ms.write_messages(rows, f"{path}/topic")
    total = sum(ms.message_ends(f"{path}/topic").values())
    limit = total // 7 + 1
    stream = ms.read_messages(spark, f"{path}/topic", maxOffsetsPerTrigger=str(limit))
    schema = "n bigint, batch_id bigint"

    def count(batch: DataFrame, batch_id: int) -> None:
        figures = batch.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
        sk.write_batch(figures, f"{path}/out", batch_id)

    writer = stream.writeStream.foreachBatch(count).option("checkpointLocation", f"{path}/checkpoint")
    running = writer.trigger(processingTime="100 milliseconds").start()
    running.processAllAvailable()
    running.stop()
    return spark.read.schema(schema).parquet(f"{path}/out")


@query
def new_predictions_since(spark, sf):
    page = fd.new_predictions_since(fx.predictions(spark, sf), 100)
    return page.select("id", "job_id", "prediction", "confidence")


@query
def latest_prediction_id(spark, sf):
    return fd.latest_prediction_id(fx.predictions(spark, sf))


# ---- sinks


@query
def publish_postings(spark, sf):
    path = scratch_path(spark)
    rows = so.normalize_posting(fx.postings(spark, sf).withColumn("timestamp", F.col("event_timestamp")).drop("created_at"))
    sk.publish_postings(rows, "json", {"path": path})
    back = spark.read.schema("key string, value string").json(path)
    return back.select("key", F.from_json("value", schemas.POSTING).alias("sent")).select("key", "sent.*")


@query
def sanitize_prediction(spark, sf):
    d = F.col("doc_id")
    raw = fx.scored(spark, sf).select(
        "job_id",
        F.concat(F.lit(" "), "title").alias("title"),
        F.when(d % 6 == 0, "x").otherwise((d % 2).cast("string")).alias("prediction"),
        F.when(d % 9 == 0, F.lit("NaN").cast("double")).otherwise(d % 13 / 10.0).alias("confidence"),
        F.when(d % 4 == 0, " ").otherwise("some reason").alias("reason"),
        F.when(d % 3 == 0, "yes").when(d % 3 == 1, "off").alias("is_anomaly"),
        F.when(d % 5 == 0, d % 7 / 5.0).alias("original_score"),
        F.when(d % 8 == 0, 0.0).when(d % 8 == 1, 1.5).alias("updated_score"),
        F.lit(None).cast("double").alias("risk_score"),
        "event_timestamp",
        F.when(d % 10 == 0, d % 3 - 1).alias("version"),
        "combined_text",
    )
    return re_.sanitize_prediction(raw).drop("reason_tags", "suspicious_keywords", "domain_pattern")


@query
def write_predictions(spark, sf):
    path = scratch_path(spark)
    rows = fx.predictions(spark, sf).withColumn("batch_id", F.floor(F.col("id") / 700))
    # the second write of the same batches replaces the first
    sk.write_predictions(rows, path, None)
    sk.write_predictions(rows, path, None)
    schema = schemas.extend(schemas.PREDICTION, "ingest_date date, batch_id bigint")
    back = spark.read.schema(schema).parquet(path)
    return back.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"))


@query
def write_batch_metrics(spark, sf):
    path = scratch_path(spark)
    sk.write_batch_metrics(fx.metrics(spark, sf).drop("throughput_jobs_per_sec"), path)
    back = spark.read.schema(schemas.BATCH_METRIC).parquet(path)
    return back.select("batch_id", "jobs_received", "jobs_failed", "throughput_jobs_per_sec", "error_rate", "source")


@query
def write_dead_letters(spark, sf):
    path, columns = scratch_path(spark), ("title", "confidence", "reason", "attempts", "failure_stage", "failure_reason")
    queue = fx.retry_queue(spark, sf).select("job_id", *columns)
    # the second write of the batch replaces the first
    for _ in range(2):
        sk.write_dead_letters(queue, path, F.col("failure_stage"), F.col("failure_reason"), 0, F.col("attempts") - 2)
    back = spark.read.parquet(path).drop("batch_id")
    return back.withColumn("payload_json", F.get_json_object("payload_json", "$.job_id"))


@query
def processed_event(spark, sf):
    return joined(re_.processed_event(ru.scored_record(fx.scored(spark, sf))), "reason")


@query
def emit_corrections(spark, sf):
    path, now = scratch_path(spark), fx.as_of(spark, sf)
    fixed = pr.apply_corrections(fx.predictions(spark, sf), fx.memberships(spark, sf), now)
    sk.emit_corrections(pr.correction_events(fixed, now), path, 0, "json", {"path": path + "-topic"})
    return spark.read.schema(schemas.CORRECTION).parquet(f"{path}/*/*")


@query
def window_metrics_sink(spark, sf):
    path = scratch_path(spark)
    stream = _event_stream(spark, sf)
    windows = an.fraud_windows(stream, "ts", "1 hour", "1 hour")
    sw.window_metrics_sink(
        windows, f"{path}/checkpoint", "table", path=f"{path}/out", available_now=True
    ).awaitTermination()
    back = sw.latest_windows(spark.read.parquet(f"{path}/out"))
    return back.select("window_start", "total_jobs", "fraud_jobs", "fraud_rate")


@query
def upgrade_predictions(spark, sf):
    old = fx.scored(spark, sf).select(
        "job_id",
        "prediction",
        "confidence",
        F.when(F.col("doc_id") % 3 == 0, 0.25).alias("updated_score"),
        F.when(F.col("doc_id") % 4 == 0, True).alias("is_anomaly"),
    )
    new = re_.upgrade_predictions(old)
    return new.select(
        "job_id", "prediction", "version", "is_corrected", "original_score", "updated_score", "risk_score", "is_anomaly"
    )


@query
def upgrade_corrections(spark, sf):
    rows = fx.corrections(spark, sf)
    kind = F.when(F.col("new_score") >= 0.9, F.col("correction_type"))
    upgraded = re_.upgrade_corrections(rows.withColumn("correction_type", kind))
    return upgraded.select("job_id", "old_score", "new_score", "updated_at", "correction_type")


# ---- features and rules


@query
def combined_text(spark, sf):
    return fx.texts(spark, sf).select("job_id", "combined_text")


@query
def event_time(spark, sf):
    return fe.event_time(fx.postings(spark, sf)).select("job_id", "event_time")


@query
def fill_missing_text(spark, sf):
    return fe.fill_missing_text(fx.training(spark, sf)).select("job_id", "title", "company_profile", "requirements")


@query
def impute_median(spark, sf):
    return fe.impute_median(fx.training(spark, sf), ["quality", "length", "nothing"]).select(
        "job_id", "quality", "length", "nothing"
    )


@query
def clean_text(spark, sf):
    return fx.postings(spark, sf).select("job_id", fe.clean_text("description").alias("cleaned"))


@query
def training_text(spark, sf):
    return fe.training_text(fx.training(spark, sf)).select("job_id", "combined_text")


@query
def posting_numbers(spark, sf):
    return fe.posting_numbers(fe.training_text(fx.training(spark, sf))).select(
        "job_id", "has_company_profile", "has_salary_range", "text_length"
    )


@query
def serve_time_features(spark, sf):
    return fe.serve_time_features(fx.texts(spark, sf)).select(
        "job_id", "has_company_profile", "has_salary_range", "text_length"
    )


@query
def posting_reason(spark, sf):
    return ru.posting_reason(fx.texts(spark, sf)).select("job_id", "reason")


@query
def keyword_hits(spark, sf):
    hits = fx.texts(spark, sf).select("job_id", ru.keyword_hits("combined_text").alias("hits"))
    return joined(hits, "hits")


@query
def suspicious_keywords(spark, sf):
    return ru.tag_postings(fx.texts(spark, sf)).select("job_id", "suspicious_keywords", "is_scorable")


@query
def domain_pattern(spark, sf):
    return fx.texts(spark, sf).select("job_id", ru.domain_pattern("company", "combined_text").alias("domain_pattern"))


@query
def base_score(spark, sf):
    return fx.scored(spark, sf).select("job_id", ru.base_score().alias("base_score"))


@query
def risk_score(spark, sf):
    return ru.scored_record(fx.scored(spark, sf)).select("job_id", "risk_score")


@query
def reason_tags(spark, sf):
    return joined(ru.scored_record(fx.scored(spark, sf)).select("job_id", "reason_tags"), "reason_tags")


@query
def scored_record(spark, sf):
    return joined(ru.scored_record(fx.scored(spark, sf)), "reason_tags")


@query
def event_latency_ms(spark, sf):
    return re_.event_latency_ms(fx.postings(spark, sf), "2024-01-03 00:00:00").select("job_id", "latency_ms")


@query
def prediction_label(spark, sf):
    words = F.when(F.col("k") % 3 == 0, " fake").when(F.col("k") % 3 == 1, F.col("event_type")).otherwise(
        (F.col("k") % 2).cast("string")
    )
    return fx.events_k(spark, sf).select("event_id", re_.prediction_label(words).alias("label"))


@query
def serve_prediction(spark, sf):
    return joined(re_.serve_prediction(fx.corrected_predictions(spark, sf)), "reason_tags").drop("prediction")


@query
def normalize_unit(spark, sf):
    value = F.when(F.col("k") % 4 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return fx.events_k(spark, sf).select("event_id", re_.normalize_unit(value).alias("unit"))


@query
def normalize_corrections(spark, sf):
    rows = fx.corrections(spark, sf)
    odd = F.when(F.col("new_score") < 0.6, "other").otherwise(F.lower("correction_type"))
    return re_.normalize_corrections(
        rows.withColumns({"correction_type": odd, "new_score": F.col("new_score") * 1.1})
    ).drop("reason")


@query
def fraud_only(spark, sf):
    return re_.fraud_only(fx.predictions(spark, sf)).select("id", "job_id", "confidence")


@query
def job_id_prefix_count(spark, sf):
    return re_.job_id_prefix_count(fx.predictions(spark, sf), "job-1")


# ---- model


@query
def tfidf_weights(spark, sf):
    return ve.tfidf_weights(fx.texts(spark, sf)).select("job_id", "term", "weight")


@query
def fit_tfidf(spark, sf):
    rows = fe.training_features(fx.training(spark, sf))
    model = mo.fit_tfidf(rows)
    size = F.aggregate(
        mo.vector_to_array("tfidf"), F.lit(0.0), lambda a, w: a + w * w
    )
    return model.transform(rows).select("job_id", F.sqrt(size).alias("norm"))


@query
def assemble_features(spark, sf):
    rows = fe.training_features(fx.training(spark, sf))
    ready = mo.assemble_features(rows, mo.fit_tfidf(rows))
    last = F.slice(mo.vector_to_array("features"), -3, 3)
    return ready.select("job_id", last[0].alias("profile"), last[1].alias("salary"), last[2].alias("length"))


@query
def train_test_split(spark, sf):
    parts = mo.train_test_split(fx.training(spark, sf))
    named = [p.select("job_id", F.lit(n).alias("part")) for n, p in zip(("train", "test"), parts)]
    return named[0].unionByName(named[1])


@query
def train(spark, sf):
    best = mo.train(fx.training(spark, sf).drop("nothing"))
    return spark.createDataFrame([(n, s, n == best.name) for n, s in best.scores.items()], "model string, f1 double, champion boolean")


def _model(rows: DataFrame) -> mo.PipelineModel:
    rows = rows.select("combined_text", *mo.NUMBERS, "fraudulent").persist()
    vectorizer = mo.fit_tfidf(rows)
    ready = mo.assemble_features(rows, vectorizer).select("fraudulent", "features").persist()
    try:
        return mo.PipelineModel([vectorizer, mo.feature_assembler(), *mo.fit_logistic(ready).stages])
    finally:
        ready.unpersist()
        rows.unpersist()


@query
def score(spark, sf):
    rows = fe.training_features(fx.training(spark, sf))
    model = _model(rows)
    path = scratch_path(spark)
    sk.save_model(model, path)
    every = fe.serve_time_features(fx.texts(spark, sf))
    return mo.score(every, sk.load_model(path)).select("job_id", "prediction", "confidence")


@query
def evaluate(spark, sf):
    rows = fx.events_k(spark, sf).select(
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("prediction"),
        F.when(F.col("k") >= 50, 1).otherwise(0).alias("fraudulent"),
    )
    return mo.evaluate(rows)


# ---- joins and clusters


@query
def corrections_with_jobs(spark, sf):
    return ins.corrections_with_jobs(fx.corrections(spark, sf), fx.predictions(spark, sf))


@query
def correction_targets(spark, sf):
    pressure = pr.cluster_pressure(fx.memberships(spark, sf))
    targets = pr.correction_targets(fx.predictions(spark, sf), pressure)
    return targets.select("job_id", "cluster_id", "count_24h", "pressure_score")


@query
def similar_prior_postings(spark, sf):
    return si.similar_prior_postings(fx.texts(spark, sf))


@query
def best_match(spark, sf):
    return si.best_match(fx.match_pairs(spark, sf))


@query
def assign_clusters(spark, sf):
    return si.assign_clusters(fx.texts(spark, sf))


@query
def cluster_memberships(spark, sf):
    return si.cluster_memberships(fx.predictions(spark, sf))


@query
def cluster_pressure(spark, sf):
    return pr.cluster_pressure(fx.memberships(spark, sf))


@query
def pressure_at_insert(spark, sf):
    return pr.pressure_at_insert(fx.memberships(spark, sf))


@query
def high_pressure_clusters(spark, sf):
    return pr.high_pressure_clusters(fx.memberships(spark, sf))


@query
def apply_corrections(spark, sf):
    fixed = pr.apply_corrections(fx.predictions(spark, sf), fx.memberships(spark, sf), fx.as_of(spark, sf))
    return fixed.select(
        "job_id", "prediction", "reason", "version", "is_corrected", "updated_score", "correction_reason",
        "old_score", "correction_type",
    )


@query
def correction_history(spark, sf):
    return fx.corrections(spark, sf)


# ---- aggregations


@query
def batch_fraud_stats(spark, sf):
    rows = fx.predictions(spark, sf).withColumn("batch_id", F.floor(F.col("id") / 700))
    return an.batch_fraud_stats(rows)


@query
def batch_metrics(spark, sf):
    return me.batch_metrics(fx.batch_rows(spark, sf)).drop("queue_backlog", "kafka_lag")


@query
def dashboard_metrics(spark, sf):
    return me.dashboard_metrics(fx.corrected_predictions(spark, sf), fx.memberships(spark, sf))


@query
def hourly_trends(spark, sf):
    return tr.hourly_trends(fx.predictions(spark, sf))


@query
def fill_hours(spark, sf):
    return tr.fill_hours(fx.predictions(spark, sf), 24, fx.as_of(spark, sf))


@query
def cluster_spikes(spark, sf):
    return tr.cluster_spikes(fx.memberships(spark, sf), fx.corrections(spark, sf))


@query
def top_clusters(spark, sf):
    return ins.top_clusters(fx.memberships(spark, sf), fx.corrected_predictions(spark, sf))


@query
def system_metrics(spark, sf):
    return me.system_metrics(fx.metrics(spark, sf), fx.predictions(spark, sf), 120)


@query
def recent_activity(spark, sf):
    return me.recent_activity(fx.predictions(spark, sf), 60)


@query
def stats(spark, sf):
    return me.stats(fx.corrected_predictions(spark, sf), fx.memberships(spark, sf), fx.metrics(spark, sf))


@query
def stream_lag(spark, sf):
    return me.stream_lag(fx.offsets(spark, sf), fx.end_offsets(spark, sf))


@query
def group_lag(spark, sf):
    ends = fx.end_offsets(spark, sf).withColumn(
        "committed", F.when(F.col("partition") != 2, F.col("end_offset") - 3 * F.col("partition") - 1)
    )
    return me.group_lag(ends)


@query
def load_summary(spark, sf):
    log = fx.events_k(spark, sf).select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"), "ts")
    seconds = log.agg(
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(1e6)).alias("s")
    ).scalar()
    return me.load_summary(log, seconds)


@query
def reason_distribution(spark, sf):
    return ins.reason_distribution(fx.alert_rows(spark, sf))


@query
def top_keywords(spark, sf):
    return ins.top_keywords(fx.alert_rows(spark, sf))


@query
def confidence_histogram(spark, sf):
    return ins.confidence_histogram(fx.alert_rows(spark, sf))


@query
def alert_intelligence(spark, sf):
    mean = fx.predictions(spark, sf).agg(F.avg("confidence").alias("c")).scalar()
    return ins.alert_intelligence(fx.alert_rows(spark, sf), mean)


@query
def category_counts(spark, sf):
    return ins.category_counts(fx.alert_rows(spark, sf))


@query
def minute_of_day_trends(spark, sf):
    return tr.minute_of_day_trends(al.latest_jobs(fx.predictions(spark, sf), 200))


@query
def critical_count(spark, sf):
    return al.critical_count(al.with_severity(fx.alert_rows(spark, sf)))


@query
def alert_categories(spark, sf):
    return al.alert_categories(fx.alert_rows(spark, sf))


@query
def correction_event_summary(spark, sf):
    return ins.correction_event_summary(
        ins.corrections_with_jobs(fx.corrections(spark, sf), fx.predictions(spark, sf))
    )


@query
def peak_throughput(spark, sf):
    rows = fx.predictions(spark, sf)
    return tr.peak_throughput(me.dashboard_metrics(rows, fx.memberships(spark, sf)), tr.hourly_trends(rows))


# ---- windows


@query
def metric_delta(spark, sf):
    return tr.metric_delta(tr.hourly_trends(fx.predictions(spark, sf)), "total_jobs")


@query
def fake_rate_series(spark, sf):
    return tr.fake_rate_series(tr.hourly_trends(fx.predictions(spark, sf)))


@query
def rolling_history(spark, sf):
    rows = tr.rolling_history(tr.hourly_trends(fx.predictions(spark, sf)), "total_jobs")
    return rows.select(
        "bucket_start", F.array_join(F.transform("history", lambda v: v.cast("int").cast("string")), "|").alias("history")
    )


@query
def cluster_heatmap(spark, sf):
    return ins.cluster_heatmap(ins.top_clusters(fx.memberships(spark, sf), fx.corrected_predictions(spark, sf)))


@query
def replay_schedule(spark, sf):
    rows = fx.postings(spark, sf).select("job_id", "doc_id", F.col("event_timestamp").alias("timestamp"))
    return rp.replay_schedule(rows, "doc_id", speed=90.0).drop("timestamp")


# ---- sorts and sets


@query
def latest_jobs(spark, sf):
    return al.latest_jobs(fx.predictions(spark, sf)).select("id", "job_id", "title", "created_at")


@query
def fake_jobs(spark, sf):
    return al.fake_jobs(fx.predictions(spark, sf)).select("id", "job_id", "title", "created_at")


@query
def alerts(spark, sf):
    return al.alerts(fx.corrected_predictions(spark, sf))


@query
def recent_corrections(spark, sf):
    return ins.recent_corrections(fx.corrections(spark, sf)).drop("reason")


@query
def alert_view(spark, sf):
    return al.alert_view(
        fx.alert_rows(spark, sf), fx.as_of(spark, sf), severity="critical", age="all", sort="newest"
    ).drop("correction_reason")


@query
def merge_alerts(spark, sf):
    rows = fx.alert_rows(spark, sf).select("id", "job_title", "risk_score", "reason", "timestamp", "level")
    newer = rows.filter(F.col("risk_score") > 0.1).withColumn(
        "level", F.lit("critical")
    ).withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 1 HOUR"))
    return al.merge_alerts(rows, newer)


@query
def live_fraud_feed(spark, sf):
    return ins.live_fraud_feed(
        ins.corrections_with_jobs(fx.corrections(spark, sf), fx.predictions(spark, sf))
    )


# ---- classifications


@query
def alert_level(spark, sf):
    rows = fx.corrected_predictions(spark, sf)
    return rows.select(
        "id",
        al.alert_level(F.round(F.col("updated_score") * 100, 2), F.col("is_corrected")).alias("level"),
        al.alert_level(F.round(F.col("original_score") * 100, 2), F.lit(False)).alias("plain_level"),
    )


@query
def alert_severity(spark, sf):
    return al.with_severity(fx.alert_rows(spark, sf)).select("id", "severity")


@query
def alert_reason(spark, sf):
    return fx.corrected_predictions(spark, sf).select(
        "id", al.alert_reason(F.col("is_corrected"), F.col("correction_reason"), F.col("reason")).alias("reason")
    )


@query
def alert_from_prediction(spark, sf):
    return fx.alert_rows(spark, sf)


@query
def alert_category(spark, sf):
    return al.with_severity(fx.alert_rows(spark, sf)).select("id", "category")


@query
def job_category(spark, sf):
    return fx.predictions(spark, sf).select("id", al.job_category(F.col("title")).alias("category"))


@query
def score_status(spark, sf):
    return fx.corrected_predictions(spark, sf).select(
        "id",
        al.score_status(F.col("updated_score")).alias("status"),
        al.score_status(F.col("updated_score"), F.col("is_corrected")).alias("forced_status"),
    )


@query
def health_status(spark, sf):
    status = he.health_status(fx.health_samples(spark, sf))
    return joined(status, "messages").select(
        "deployment", "sample_at", "kafka", "spark", "db", "ml", "messages", "degraded"
    )


@query
def system_mode(spark, sf):
    status = he.health_status(fx.health_samples(spark, sf))
    return joined(he.system_mode(status, "deployment"), "messages").select(
        "deployment", "sample_at", "mode", "messages", "degraded"
    )


@query
def bucket_label(spark, sf):
    return fx.predictions(spark, sf).select("id", tr.bucket_label("created_at").alias("label"))


@query
def spike_pressure(spark, sf):
    return tr.spike_pressure(tr.cluster_spikes(fx.memberships(spark, sf), fx.corrections(spark, sf)))


# ---- surges, retry, streams


@query
def fraud_windows(spark, sf):
    rows = an.fraud_windows(fx.predictions(spark, sf), "created_at")
    return rows.select("window_start", "total_jobs", "fraud_jobs", "fraud_rate")


def _hours(spark: SparkSession, sf: str) -> DataFrame:
    return an.fraud_windows(fx.predictions(spark, sf), "created_at", "1 hour").select(
        F.lit("all").alias("stream"), "window_start", "total_jobs", "fraud_jobs", "fraud_rate"
    )


@query
def ema_anomaly(spark, sf):
    return an.ema_anomaly(_hours(spark, sf)).drop("stream")


@query
def ema_baseline(spark, sf):
    return an.ema_anomaly(_hours(spark, sf)).select("window_start", "ema_count", "ema_rate")


@query
def tag_batch_anomaly(spark, sf):
    rows = fx.predictions(spark, sf).withColumn("batch_id", F.floor(F.col("id") / 700))
    stats = an.batch_fraud_stats(rows).withColumn("stream", F.lit("all"))
    marks = an.ema_anomaly(stats, order="batch_id")
    return an.tag_batch_anomaly(rows, marks).select("job_id", "batch_id", "batch_is_anomaly", "batch_anomaly_reason")


@query
def retry_plan(spark, sf):
    waiting, dead = rt.retry_plan(fx.retry_queue(spark, sf), "2024-02-01 00:00:00")
    columns = ("job_id", "attempts", "next_retry_at", "stage", "reason")
    first = waiting.select("job_id", "attempts", "next_retry_at", F.lit("").alias("stage"), F.lit("").alias("reason"))
    last = dead.select(
        "job_id", F.col("retry_count").alias("attempts"), F.lit(None).cast("timestamp_ntz").alias("next_retry_at"),
        F.col("failure_stage").alias("stage"), F.col("failure_reason").alias("reason"),
    )
    return first.unionByName(last).select(*columns)


@query
def due_retries(spark, sf):
    return rt.due_retries(fx.retry_queue(spark, sf), "2024-01-20 00:00:00").select("job_id", "queued_at", "next_retry_at")


@query
def cap_backlog(spark, sf):
    stays, dead = rt.cap_backlog(fx.retry_queue(spark, sf), 500)
    return stays.select("job_id", F.lit("queue").alias("place")).unionByName(
        dead.select("job_id", F.col("failure_stage").alias("place"))
    )


@query
def retry_pass(spark, sf):
    good = F.col("confidence") < 0.1
    out = rt.retry_pass(
        fx.retry_queue(spark, sf), lambda due: (due.filter(good), due.filter(~good)), "2024-01-20 00:00:00"
    )
    return (
        out["stored"].select("job_id", F.lit("stored").alias("place"))
        .unionByName(out["queue"].select("job_id", F.lit("queue").alias("place")))
        .unionByName(out["dead"].select("job_id", F.lit("dead").alias("place")))
    )


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = fx.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("prediction"),
    )


@query
def stream_ema_anomaly(spark, sf):
    path = scratch_path(spark)
    windows = an.fraud_windows(_event_stream(spark, sf), "ts", "1 hour", "1 hour")
    marked = sw.stream_ema_anomaly(windows)
    _to_files(marked, path)
    return spark.read.schema(marked.schema).parquet(f"{path}/out").drop("stream")


@query
def live_counters(spark, sf):
    path, name = scratch_path(spark), "live_counters_" + uuid.uuid4().hex
    rows = fx.predictions(spark, sf).withColumn("batch_id", F.floor(F.col("id") / 700))
    sk.write_predictions(rows, f"{path}/predictions", None)
    counters = st.live_counters(st.prediction_stream(spark, path, 1000)).writeStream.outputMode("complete")
    counters = counters.format("memory").queryName(name).option("checkpointLocation", f"{path}/checkpoint")
    counters.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query
def alert_stream(spark, sf):
    path = scratch_path(spark)
    rows = fx.corrected_predictions(spark, sf).withColumn("batch_id", F.floor(F.col("id") / 700))
    sk.write_predictions(rows, f"{path}/predictions", None)
    alerts = st.alert_stream(st.prediction_stream(spark, path, 1000))
    _to_files(alerts, path)
    return spark.read.schema(alerts.schema).parquet(f"{path}/out")


@query
def score_stream(spark, sf):
    path = scratch_path(spark)
    rows = fe.training_features(fx.training(spark, sf))
    model = _model(rows)
    _messages(spark, sf).select("value").write.text(f"{path}/in")
    stream = ss.read_postings_stream(spark, "text", f"{path}/in", maxFilesPerTrigger="4")
    st.score_stream(stream, model, f"{path}/tables", available_now=True).awaitTermination()
    return Tables(spark, f"{path}/tables").predictions().select(
        "job_id", "prediction", "confidence", "is_corrected", "updated_score"
    )


@query
def snapshot(spark, sf):
    written = [
        cut_lineage(f(spark, sf)) for f in (fx.corrected_predictions, fx.memberships, fx.corrections, fx.metrics)
    ]
    frames = snapshot_frames(*written, fx.as_of(spark, sf), system_minutes=120, recent_minutes=60, fixes=50)
    out = None
    for name, frame in frames.items():
        rows = snapshot_rows(name, frame)
        out = rows if out is None else out.unionByName(rows)
    return out


#: What names a row of a frame, and its figures.
FRAMES = {
    "metrics": (
        None, "total_jobs fake_jobs real_jobs fake_percentage throughput avg_confidence processing_latency_ms "
        "corrected_jobs high_pressure_clusters",
    ),
    "alerts": ("job_id", "risk risk_score"),
    "trends": ("bucket_start", "total_jobs fake_jobs real_jobs throughput"),
    "corrections": ("job_id", "old_score new_score"),
    "top_clusters": ("cluster_id", "jobs_1h jobs_6h jobs_24h pressure_score corrected_jobs peak_score"),
    "cluster_spikes": ("bucket_start", "cluster_jobs corrections"),
    "system_metrics": (
        None, "throughput_jobs_per_sec avg_latency_ms error_rate fraud_rate anomaly_rate kafka_lag "
        "spark_batch_time_ms db_insert_time_ms queue_backlog samples",
    ),
    "recent_activity": (None, "recent_jobs"),
}


def snapshot_rows(name: str, frame: DataFrame) -> DataFrame:
    """(frame, item, figure, value): every figure of every row of a frame."""
    key, figures = FRAMES[name]
    item = F.date_format(key, "yyyy-MM-dd HH:mm:ss") if key == "bucket_start" else F.col(key) if key else F.lit("")
    value = lambda c: (F.round(F.col(c).cast("double"), 6) + 0.0).alias("value")
    pairs = F.array(*[F.struct(F.lit(c).alias("figure"), value(c)) for c in figures.split()])
    return frame.select(F.lit(name).alias("frame"), item.cast("string").alias("item"), F.inline(pairs))


def snapshot_frames(
    predictions, members, corrections, metrics, as_of, system_minutes=5, recent_minutes=2, fixes=25
) -> dict[str, DataFrame]:
    """All frames of the dashboard at one instant; the inputs are read by several frames,
    so they should be written tables."""
    return {
        "metrics": me.dashboard_metrics(predictions, members, as_of),
        "alerts": al.alerts(predictions, 25),
        "trends": tr.hourly_trends(predictions, 24, as_of),
        "corrections": ins.corrections_with_jobs(corrections, predictions, fixes),
        "top_clusters": ins.top_clusters(members, predictions, 8, as_of),
        "cluster_spikes": tr.cluster_spikes(members, corrections, 24, as_of),
        "system_metrics": me.system_metrics(metrics, predictions, system_minutes, as_of),
        "recent_activity": me.recent_activity(predictions, recent_minutes, as_of),
    }
