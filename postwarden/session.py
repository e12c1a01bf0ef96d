"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LISTING_TASKS = 48

#: Rows of long texts come in parts of this size: what goes to a Python worker at once, what
#: a reader holds as columns, and what a writer holds before it goes to the file.
PART_BYTES, PART_ROWS = 4 << 20, 1024

#: The folders that ``cut_lineage`` has written for the innermost ``settled``.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def build_session(app: str = "postwarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Naive times mean UTC everywhere in the library."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def bounded_listing(spark: SparkSession) -> SparkSession:
    """A table with a folder for each batch is listed by some tasks, not by one for each
    folder, whose results would all go to the driver."""
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(LISTING_TASKS))
    return spark


def bounded_parts(spark: SparkSession) -> SparkSession:
    """Rows of long texts are read, sent to Python and written in parts of a few megabytes,
    of which each running task holds several, instead of in parts of its whole split."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PART_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(PART_ROWS))
    spark.conf.set("parquet.block.size", str(PART_BYTES))
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only
    on a local master where the setting is absent."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="postwarden-checkpoint-")
    context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    Survives the loss of executors. Unlike a checkpointed RDD the table keeps its
    size and columns known, so later joins are planned by real sizes and read
    only what they use.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame | tuple[DataFrame, ...]]) -> DataFrame | tuple[DataFrame, ...]:
    """``cut_lineage`` of what ``make`` returns, one table or several. The tables that
    ``cut_lineage`` wrote inside ``make`` are deleted once the results are written, so nothing
    else may read them.
    """
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        made = make()
    finally:
        _WRITTEN.reset(token)
    several = made if isinstance(made, tuple) else (made,)
    result = tuple(cut_lineage(df) for df in several)
    spark = several[0].sparkSession
    for path in written:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return result if isinstance(made, tuple) else result[0]
