"""Event-time windows and the surge baseline as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Config
from ..operators.anomaly import smoothing, surge_marks
from ..session import STATE_STORE
from ..sinks.tables import write_batch

_STATE = "ema_count double, ema_rate double"
_MEANS = (
    "stream string, window_start timestamp, total_jobs bigint, fraud_jobs bigint, fraud_rate double, "
    "prior_count double, prior_rate double, ema_count double, ema_rate double"
)


class MeansProcessor(StatefulProcessor):
    """Keeps the two means of one stream key and gives each window those before and
    after it; what they say about the window is left to column expressions."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.means = handle.getValueState("means", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the windows of one key that one trigger closed, a row for each hour or minute
        closed = pd.concat(list(rows)).sort_values("window_start", ignore_index=True)
        figures = closed[["fraud_jobs", "fraud_rate"]].astype(float).set_axis(["count", "rate"], axis=1)
        if self.means.exists():
            held = pd.DataFrame([tuple(self.means.get())], columns=["count", "rate"])
            after = pd.concat([held, figures]).ewm(alpha=self.alpha, adjust=False).mean()
            before, after = after.iloc[:-1], after.iloc[1:]
        else:
            after = figures.ewm(alpha=self.alpha, adjust=False).mean()
            before = after.shift(1)
        self.means.update(tuple(after.iloc[-1]))
        parts = {
            "stream": key[0],
            **{c: closed[c].to_numpy() for c in ("window_start", "total_jobs", "fraud_jobs", "fraud_rate")},
            **{f"prior_{c}": before[c].to_numpy() for c in ("count", "rate")},
            **{f"ema_{c}": after[c].to_numpy() for c in ("count", "rate")},
        }
        yield pd.DataFrame(parts)

    def close(self) -> None:
        pass


def stream_ema_anomaly(windows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Surge flags for closed windows of a stream (``fraud_windows`` with a watermark
    and a ``stream`` column)."""
    spark = windows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keyed = windows if "stream" in windows.columns else windows.withColumn("stream", F.lit("all"))
    rows = keyed.select("stream", "window_start", "total_jobs", "fraud_jobs", "fraud_rate")
    means = rows.groupBy("stream").transformWithStateInPandas(
        statefulProcessor=MeansProcessor(smoothing(config)),
        outputStructType=_MEANS,
        outputMode="Append",
        timeMode="None",
    )
    flag, text = surge_marks(config)
    return means.select(
        *rows.columns, flag.alias("is_anomaly"), text.alias("anomaly_reason"), "ema_count", "ema_rate"
    )


def window_metrics_sink(
    windows: DataFrame,
    checkpoint: str,
    format: str = "memory",
    name: str = "fraud_window_metrics",
    path: str | None = None,
    mode: str = "append",
    available_now: bool = False,
) -> StreamingQuery:
    """Window figures to a table in memory or to files, with their own checkpoint.

    ``table`` writes each change of a window below ``path``, open windows included;
    ``latest_windows`` reads their present state.
    """
    if format == "table":
        changes = windows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        changes = changes.foreachBatch(lambda rows, batch_id: write_batch(rows, path, batch_id))
        return (changes.trigger(availableNow=True) if available_now else changes).start()
    writer = windows.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name)
    if path:
        writer = writer.option("path", path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_windows(windows: DataFrame) -> DataFrame:
    """The present state of each window from the table of its changes."""
    rest = [c for c in windows.columns if c not in ("window_start", "batch_id")]
    newest = F.max(F.struct("batch_id", *rest)).alias("newest")
    return windows.groupBy("window_start").agg(newest).select("window_start", *[f"newest.{c}" for c in rest])


_MODES = "deployment string, sample_at timestamp_ntz, mode string, by_timer boolean"


class ModeProcessor(StatefulProcessor):
    """Mode of a deployment for each sample, and a row of its own once the recovery time
    has passed by the clock, whether another sample comes or not."""

    def __init__(self, recovery_seconds: int):
        self.recovery = pd.Timedelta(seconds=recovery_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # an unhealthy sample was seen; when the first healthy one after it was, if any
        self.state = handle.getValueState("mode", "degraded boolean, healthy_us bigint, timer_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("sample_at", ignore_index=True)
        unhealthy, since, timer = (bool(s[0]), s[1], s[2]) if (s := self._get()) else (False, -1, -1)
        modes = []
        for at, degraded in zip(own["sample_at"], own["degraded"]):
            if degraded:
                unhealthy, since, mode = True, -1, "degraded"
            elif not unhealthy:
                mode = "normal"
            else:
                since = since if since >= 0 else at.value // 1000
                mode = "normal" if at - pd.Timestamp(since * 1000) > self.recovery else "recovery"
            modes.append(mode)
        if timer >= 0 and modes[-1] != "recovery":
            self.handle.deleteTimer(timer)
            timer = -1
        elif timer < 0 and modes[-1] == "recovery":
            timer = timerValues.getCurrentProcessingTimeInMs() + int(self.recovery.total_seconds() * 1000) + 1
            self.handle.registerTimer(timer)
        self.state.update((unhealthy, since, timer))
        yield pd.DataFrame({"deployment": key[0], "sample_at": own["sample_at"], "mode": modes, "by_timer": False})

    def _get(self) -> tuple | None:
        return self.state.get() if self.state.exists() else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        unhealthy, since, _ = self.state.get()
        self.state.update((unhealthy, since, -1))
        ended = pd.Timestamp(since * 1000) + self.recovery
        yield pd.DataFrame({"deployment": [key[0]], "sample_at": [ended], "mode": ["normal"], "by_timer": [True]})

    def close(self) -> None:
        pass


def stream_system_mode(status: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """(deployment, sample_at, mode, by_timer) for a stream of ``health_status`` rows.

    Samples get the mode that ``system_mode`` gives them in a table; they must come in
    the order of time, as far as one deployment goes. A deployment that stays in recovery
    without a further sample gets a row ``normal`` by timer.
    """
    status.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = status.select(F.col(key).cast("string").alias("deployment"), "sample_at", "degraded")
    return rows.groupBy("deployment").transformWithStateInPandas(
        statefulProcessor=ModeProcessor(config.recovery_seconds),
        outputStructType=_MODES,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
