"""What a running query reports about itself, kept as rows."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from .. import schemas

PROGRESS = schemas.struct(
    "query string, batch_id bigint, started_at string, received bigint, processed_per_second double, "
    "batch_ms bigint, end_offset string, lag bigint"
)


def offset_lag(end: str | None, latest: str | None) -> int:
    """Records between two offsets as sources write them, {partition: offset} or
    {topic: {partition: offset}}; 0 where a source has no such offsets."""

    def flat(text: str | None) -> dict[str, int]:
        try:
            value = json.loads(text or "{}")
        except ValueError:
            return {}
        out: dict[str, int] = {}
        for name, part in value.items() if isinstance(value, dict) else ():
            if isinstance(part, dict):
                out |= {f"{name}-{p}": n for p, n in part.items() if isinstance(n, int)}
            elif isinstance(part, int) and name.isdigit():
                out[name] = part
        return out

    done = flat(end)
    return sum(max(n - done.get(p, 0), 0) for p, n in flat(latest).items())


class ProgressLog(StreamingQueryListener):
    """Appends a row for each micro-batch with input to the table ``stream_progress``
    below ``root``. Add it by ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/stream_progress"

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress
        if not told.numInputRows:
            return
        source = told.sources[0]
        row = (
            told.name or str(told.id), told.batchId, told.timestamp, told.numInputRows, told.processedRowsPerSecond,
            told.batchDuration, source.endOffset, offset_lag(source.endOffset, source.latestOffset),
        )
        frame = self.spark.createDataFrame([row], PROGRESS)
        frame.coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
