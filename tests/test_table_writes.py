"""Writes of many batches at once: files, tasks and what the driver gets."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from postwarden.sinks.tables import write_batch, write_batch_metrics
from postwarden.streaming.tables import Tables


def files(path):
    return sorted(Path(path).glob("**/*.parquet"))


def test_one_file_for_each_batch_from_many_tasks(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select("id", (F.col("id") % 20).alias("batch_id"), F.lit("2024-01-01").alias("at"))
    for _ in range(2):
        write_batch(rows, str(tmp_path / "rows"), None, "at")
    assert len(files(tmp_path / "rows")) == 20 and spark.read.parquet(str(tmp_path / "rows")).count() == 4000


def test_a_bulk_write_replaces_its_batches_alone(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 10).alias("batch_id"))
    write_batch(rows, str(tmp_path / "rows"), None)
    write_batch(rows.filter("batch_id = 3 AND id < 50"), str(tmp_path / "rows"), None)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 95


def test_metrics_of_many_batches_are_written_by_many_tasks(spark, tmp_path):
    write_batch_metrics(spark.range(0, 60, 1, 1).select(F.col("id").alias("batch_id")), str(tmp_path / "metrics"))
    found = files(tmp_path / "metrics")
    assert len(found) == 60 and len({f.name.split("-")[1] for f in found}) > 3


def test_folders_are_listed_by_a_bounded_number_of_tasks(spark, tmp_path):
    write_batch(spark.range(400).withColumn("batch_id", F.col("id")), str(tmp_path / "rows"), None)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        rows = Tables(spark, str(tmp_path)).read("rows", spark.range(1).schema)
        tracker = spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
        assert stages and sum(tracker.getStageInfo(s).numTasks for s in stages) < 100
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows.count() == 400


def test_terms_are_counted_without_a_shuffle(spark):
    from collections import Counter

    from postwarden.operators.vectors import term_counts

    texts = [("a", "x yy yy Zz zz zz, yy"), ("b", None), ("c", "one"), ("d", "q"), ("e", "bb aa bb")]
    found = term_counts(spark.createDataFrame(texts, "job_id string, combined_text string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(d, w): n for d, t in texts for w, n in Counter(w for w in (t or "").lower().replace(",", "").split() if len(w) > 1).items()}
    assert {(r["job_id"], r["term"]): r["tf"] for r in found.collect()} == want


def test_the_history_of_corrections_is_put_in_order_once(spark, monkeypatch):
    from postwarden.functions import layout
    from postwarden.operators import pressure

    calls, plain = [], layout.global_order
    count = lambda *a, **k: calls.append(1) or plain(*a, **k)
    monkeypatch.setattr(layout, "global_order", count)
    monkeypatch.setattr(pressure, "global_order", count, raising=False)
    rows = spark.range(30).selectExpr(
        "concat('j', id) AS job_id", "'c' AS cluster_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id AS int)) AS created_at",
        "0 AS prediction", "0.4D AS original_score", "0.4D AS updated_score", "false AS is_corrected", "0.5D AS confidence",
    )
    assert pressure.correction_history(rows, rows.select("cluster_id", "job_id", "created_at")).count() > 20
    assert len(calls) == 1


def test_training_rows_of_one_file_are_spread(spark, monkeypatch):
    from postwarden.operators import model
    from postwarden.plans import fixtures

    seen = []
    stop = lambda rows, label: seen.append(rows.rdd.getNumPartitions()) or 1 / 0
    monkeypatch.setattr(model, "fit_logistic", stop)
    try:
        model.train(fixtures.training(spark, "/root/testdata/sf0.001").coalesce(1).drop("nothing"))
    except ZeroDivisionError:
        pass
    assert seen and seen[0] >= spark.sparkContext.defaultParallelism
