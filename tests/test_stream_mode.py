"""The mode of a stream against the mode of a table, and the row that a timer makes."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postwarden.config import Config
from postwarden.operators import health
from postwarden.streaming.windows import stream_system_mode

KIND = "deployment string, sample_at timestamp_ntz, kafka_running boolean, db_connected boolean, ml_loaded boolean, recent_jobs int, kafka_lag bigint"


def test_stream_equals_table_and_recovers_by_timer(spark, tmp_path):
    config, path = Config(recovery_seconds=3), str(tmp_path / "samples")
    begin = datetime(2024, 1, 1)
    good = lambda name, i: (i * 7 + len(name)) % 5 != 0
    rows = [(n, begin + timedelta(seconds=2 * i), good(n, i), True, True, 0, 0) for n in ("a", "bb", "ccc") for i in range(24)]
    rows += [("bb", begin + timedelta(seconds=48), False, True, True, 0, 0), ("bb", begin + timedelta(seconds=49), True, True, True, 0, 0)]
    samples = spark.createDataFrame(rows, KIND)
    status = health.health_status(samples, config)
    want = sorted(tuple(r) for r in health.system_mode(status, "deployment", config).select("deployment", "sample_at", "mode").collect())
    middle = begin + timedelta(seconds=20)
    samples.filter(F.col("sample_at") < middle).coalesce(1).write.parquet(path + "/1")
    stream = spark.readStream.schema(samples.schema).option("recursiveFileLookup", "true").parquet(path)
    modes = stream_system_mode(health.health_status(stream, config), "deployment", config)
    query = modes.writeStream.format("memory").queryName("modes").option("checkpointLocation", str(tmp_path / "cp"))
    query = query.trigger(processingTime="500 milliseconds").start()
    rows_of = lambda timed: [tuple(r)[:3] for r in spark.table("modes").filter(F.col("by_timer") == timed).collect()]
    end = time.time() + 120
    while len(rows_of(False)) < 30 and time.time() < end:
        time.sleep(0.2)
    samples.filter(F.col("sample_at") >= middle).coalesce(1).write.parquet(path + "/2")
    ended = ("bb", begin + timedelta(seconds=52), "normal")
    while not (len(rows_of(False)) == len(want) and ended in rows_of(True)) and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert sorted(rows_of(False)) == want
    assert ended in rows_of(True)
