"""The scoring stream: one pass over the source, several idempotent writes."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..config import DEFAULT, Config
from ..functions.layout import global_order
from ..functions.scalars import as_time, count_if, hours, is_one
from ..operators.alerts import alert_from_prediction
from ..operators.anomaly import smoothing, surge_marks
from ..operators.features import clean_text, combined_text, serve_time_features
from ..operators.metrics import batch_metrics, stream_lag
from ..operators.model import score
from ..operators.pressure import apply_corrections, correction_events, latest_versions
from ..operators.records import dead_letter_records, event_latency_ms, processed_event, sanitize_prediction
from ..operators.retry import enqueue
from ..operators.rules import posting_reason, scored_record
from ..operators.similarity import assign_clusters, cluster_memberships
from ..session import bounded_listing, settled
from ..sinks.tables import (
    emit_corrections,
    publish,
    write_batch,
    write_batch_metrics,
    write_memberships,
    write_predictions,
)
from .messages import message_ends
from .repeats import marked_repeats
from .retries import QUEUED, Attempt, drop_overflow, pending, queue_failed
from .tables import BATCH_STATE, Tables


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def scored_postings(postings: DataFrame, model: PipelineModel) -> DataFrame:
    """Features, class, confidence and reason for a batch or a stream.

    The model reads the text cleaned as in training; rules and clusters read it as
    it came. A posting has no salary field, so the numbers come from the text.
    """
    raw = serve_time_features(combined_text(postings))
    cleaned = raw.withColumn("raw_text", F.col("combined_text")).withColumn(
        "combined_text", clean_text("combined_text")
    )
    return posting_reason(score(cleaned, model).withColumn("combined_text", F.col("raw_text")).drop("raw_text"))


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class BatchWriter:
    """Handles one micro-batch: surge check, records, clusters, corrections, metrics.

    The surge baseline and the clock of each batch are rows of a small state table,
    so a restart goes on where it stopped and a replayed batch writes the same rows.
    Clusters weigh all terms: by the ``idf`` table, if one is given, so that weights
    do not change from batch to batch, else by the batch and its window.

    ``insert`` is a sink outside the lake; what it refuses goes to the retry queue, which
    ``drain_retries`` empties. No posting is lost: malformed and repeated ones are dead
    letters. ``message_path`` is the folder of the message source, for the lag.
    """

    def __init__(
        self,
        tables: Tables,
        config: Config = DEFAULT,
        processed_format: str | None = None,
        processed_options: dict[str, str] | None = None,
        insert: Attempt | None = None,
        message_path: str | None = None,
        idf: DataFrame | None = None,
    ):
        self.tables = tables
        self.config = config
        self.processed_format = processed_format
        self.processed_options = processed_options or {}
        self.insert = insert
        self.message_path = message_path
        self.idf = idf

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            self._write(batch, batch_id)
        finally:
            batch.unpersist()

    def _judge(self, good: DataFrame, batch_id: int) -> tuple[datetime, bool, str]:
        """Time and surge flag of the batch; recorded before anything else is written."""
        states = self.tables.read("batch_state", BATCH_STATE)
        past = states.filter(F.col("batch_id") <= batch_id).orderBy(F.desc("batch_id")).limit(2).collect()
        mine = next((r for r in past if r["batch_id"] == batch_id), None)
        if mine is not None:
            return datetime.fromisoformat(mine["started_at"]), mine["is_anomaly"], mine["anomaly_reason"]
        now = _now()
        means = (past[0]["ema_count"], past[0]["ema_rate"]) if past else (None, None)
        a = smoothing(self.config)
        flag, reason = surge_marks(self.config)
        figures = good.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(count_if(is_one("prediction")), F.lit(0)).alias("fraud_jobs")
        ).select(
            "fraud_jobs",
            (F.col("fraud_jobs") / F.greatest("n", F.lit(1))).alias("fraud_rate"),
            *[F.lit(m).cast("double").alias(f"prior_{c}") for m, c in zip(means, ("count", "rate"))],
        )
        moved = [
            F.coalesce(a * F.col(v) + (1 - a) * F.col(f"prior_{c}"), F.col(v)).cast("double").alias(f"ema_{c}")
            for v, c in (("fraud_jobs", "count"), ("fraud_rate", "rate"))
        ]
        state = figures.select(
            F.lit(now.isoformat()).alias("started_at"),
            *moved,
            flag.alias("is_anomaly"),
            reason.alias("anomaly_reason"),
        ).first()
        flag, reason = state["is_anomaly"], state["anomaly_reason"]
        row = good.sparkSession.createDataFrame([(batch_id, *state)], BATCH_STATE)
        write_batch(row.drop("batch_id"), self.tables.path("batch_state"), batch_id)
        return now, flag, reason

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        tables, config = self.tables, self.config
        if batch.isEmpty():
            return
        repeated = F.col("is_repeat") if "is_repeat" in batch.columns else F.lit(False)
        good = batch.filter(~F.col("is_malformed") & ~repeated)
        bad = batch.filter("is_malformed")
        now, flag, reason = self._judge(good, batch_id)
        clock = as_time(now)

        records = scored_record(
            good.withColumns({"batch_is_anomaly": F.lit(flag), "batch_anomaly_reason": F.lit(reason)}), config
        )
        clean = sanitize_prediction(records).withColumn("created_at", clock)
        # a replayed batch keeps the same one of several rows with an id
        place = F.struct("event_timestamp", F.xxhash64("title", "text_blob"))
        newest = Window.partitionBy("job_id").orderBy(place)
        numbered = clean.withColumn("_nth", F.row_number().over(newest))
        once = numbered.filter("_nth = 1").drop("_nth")
        # batches that replay must not see their own rows
        earlier = tables.predictions(as_stored=True).filter(F.col("batch_id") < batch_id)
        frame = tables.recent(earlier, now, config.lookback_hours)
        pool = frame.select(
            "job_id", "created_at", F.col("text_blob").alias("combined_text"), "title", "cluster_id",
            F.lit(False).alias("asks"),
        ).unionByName(
            once.select(
                "job_id", "created_at", F.col("text_blob").alias("combined_text"), "title", "cluster_id",
                F.lit(True).alias("asks"),
            )
        )
        # the texts of the window are read several times
        pool = pool.dropDuplicates(["job_id"]).persist()
        try:
            clusters = settled(lambda: assign_clusters(pool, config, idf=self.idf))
        finally:
            pool.unpersist()
        # ids grow from batch to batch, so a feed that pages by them misses none
        order = global_order(once.select("job_id"), ["job_id"], "_place").select("job_id", "_place")
        stored = once.drop("cluster_id").join(clusters, "job_id").join(order, "job_id")
        stored = stored.withColumn("id", F.lit(batch_id << 32).cast("bigint") + F.col("_place") + 1)
        names = [f.name for f in schemas.PREDICTION.fields]
        write_predictions(stored.select(*names), tables.path("predictions"), batch_id)
        mine = tables.predictions(as_stored=True).filter(F.col("batch_id") == batch_id)
        write_memberships(cluster_memberships(mine), tables.path("memberships"), batch_id)
        inserted_at = _now()

        self._correct(mine, now, batch_id)

        self._letters(batch.filter(~F.col("is_malformed") & repeated), bad, numbered.filter("_nth > 1"), mine, batch_id)
        if self.processed_format:
            publish(processed_event(mine), "id", self.processed_format, self.processed_options)
        self._measure(batch, mine, bad, now, inserted_at, batch_id)

    def _letters(
        self, repeats: DataFrame, bad: DataFrame, again: DataFrame, stored: DataFrame, batch_id: int
    ) -> None:
        """Give the stored rows to the sink, queue what it refuses, and write a dead
        letter for every posting that is not stored."""
        tables, config = self.tables, self.config
        raw = lambda df, reason: dead_letter_records(df.select("job_id", "title", "raw_value"), "parse", reason)
        letters = raw(bad, "malformed JSON")
        for rows in (repeats.select("job_id", "title", "raw_value"), again.drop("_nth")):
            letters = letters.unionByName(dead_letter_records(rows, "dedupe", "repeated id"))
        if self.insert:
            queued = tables.read("retry_queue/from=stream", QUEUED).filter(F.col("batch_id") == batch_id)
            # a batch that runs again has queued its rows already, and they may have moved on
            if queued.isEmpty():
                _, failed = self.insert(stored.select(*[f.name for f in schemas.PREDICTION.fields]))
                queue_failed(tables, enqueue(failed, F.lit(_now())), "stream", batch_id)
            if pending(tables).count() > config.max_backlog:
                letters = letters.unionByName(drop_overflow(tables, batch_id, config))
        write_batch(letters, tables.path("dead_letters"), batch_id)

    def _lag(self, batch: DataFrame) -> int:
        """Messages behind those of the batch."""
        if not self.message_path:
            return 0
        ends = [(int(p), end) for p, end in message_ends(self.message_path).items()]
        rows = batch.sparkSession.createDataFrame(ends, "partition int, end_offset bigint")
        return stream_lag(batch, rows).first()["lag"]

    def _correct(self, mine: DataFrame, now: datetime, batch_id: int) -> None:
        """Corrections in the clusters that this batch touched (at most one per row)."""
        tables, clock = self.tables, as_time(now)
        touched = F.broadcast(mine.select("cluster_id").distinct())
        first = tables.predictions(as_stored=True).filter(F.col("batch_id") <= batch_id)
        newer = tables.read("prediction_versions", schemas.PREDICTION).filter(F.col("batch_id") < batch_id)
        in_touched = lambda df: df.join(touched, "cluster_id", "left_semi")
        names = [f.name for f in schemas.PREDICTION.fields]
        current = latest_versions(in_touched(first).select(*names), in_touched(newer).select(*names))
        members = tables.recent(tables.memberships(), now, 25).filter(F.col("batch_id") <= batch_id)
        # the members of a batch share its instant and count at once
        members = members.join(touched, "cluster_id", "left_semi")
        corrected = apply_corrections(current, members, clock, self.config).persist()
        try:
            write_batch(corrected.select(*names), tables.path("prediction_versions"), batch_id, "created_at")
            emit_corrections(correction_events(corrected, clock), tables.path("corrections"), batch_id)
        finally:
            corrected.unpersist()

    def _measure(
        self,
        batch: DataFrame,
        mine: DataFrame,
        bad: DataFrame,
        started: datetime,
        inserted_at: datetime,
        batch_id: int,
    ) -> None:
        done = _now()
        seen = event_latency_ms(mine, as_time(done)).select(
            "prediction", "is_anomaly", F.lit(True).alias("inserted"), "latency_ms"
        )
        lost = bad.select(
            F.lit(0).alias("prediction"),
            F.lit(False).alias("is_anomaly"),
            F.lit(False).alias("inserted"),
            F.lit(None).cast("double").alias("latency_ms"),
        )
        rows = seen.unionByName(lost).withColumns(
            {
                "batch_id": F.lit(batch_id).cast("bigint"),
                "started_at": as_time(started),
                "insert_done_at": as_time(inserted_at),
                "completed_at": as_time(done),
            }
        )
        backlog = pending(self.tables).count() if self.insert else 0
        figures = batch_metrics(rows, backlog, self._lag(batch)).withColumn("created_at", as_time(started))
        write_batch_metrics(figures, self.tables.path("batch_metrics"), batch_id)


def score_stream(
    postings: DataFrame,
    model: PipelineModel,
    root: str,
    config: Config = DEFAULT,
    available_now: bool = False,
    **writer: object,
) -> StreamingQuery:
    """Start scoring ``postings`` into the tables below ``root``; ``writer`` are the
    options of ``BatchWriter``."""
    spark = postings.sparkSession
    tables = Tables(spark, root)
    writer = BatchWriter(tables, config, **writer)
    scored = scored_postings(marked_repeats(postings), model)
    query = scored.writeStream.foreachBatch(writer).option("checkpointLocation", tables.path("_checkpoint"))
    query = query.trigger(availableNow=True) if available_now else query.trigger(processingTime=config.trigger_interval)
    # keyed state by the clock asks for one empty batch after the other, so a run over what
    # is there would never end; ids are forgotten in batches with data as well
    empty = spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set(_EMPTY_BATCHES, "false")
    try:
        return query.start()
    finally:
        # the query has its own copy; others need empty batches for their timers
        spark.conf.set(_EMPTY_BATCHES, empty)


def prediction_stream(spark: SparkSession, root: str, max_files: int = 50) -> DataFrame:
    """Newly stored predictions as a stream."""
    schema = schemas.extend(schemas.PREDICTION, "ingest_date date, batch_id bigint")
    reader = bounded_listing(spark).readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{root}/predictions")


def alert_stream(predictions: DataFrame) -> DataFrame:
    """Alerts for new fraudulent predictions; the same rule as for a batch."""
    return alert_from_prediction(predictions)


def live_counters(predictions: DataFrame) -> DataFrame:
    """Running totals; on a stream use complete or update mode."""
    totals = predictions.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        count_if(is_one("prediction")).alias("fake_jobs"),
        F.max("created_at").alias("last_processed_at"),
    )
    return totals.select(
        "total_jobs",
        "fake_jobs",
        (F.col("total_jobs") - F.col("fake_jobs")).alias("real_jobs"),
        F.coalesce(F.try_divide(F.col("fake_jobs") * 100.0, F.col("total_jobs")), F.lit(0.0)).alias(
            "fake_percentage"
        ),
        "last_processed_at",
    )
