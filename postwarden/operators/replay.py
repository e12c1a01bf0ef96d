"""Event-time pacing of a replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.layout import global_order
from ..functions.scalars import micros, parse_time


def replay_schedule(
    df: DataFrame,
    order: str,
    speed: float = 1.0,
    max_delay: float = 2.0,
    rate: float = 0.0,
    source: str = "timestamp",
) -> DataFrame:
    """Delay before each event and its release time, in seconds from the start.

    An event waits for the gap to the last readable time before it, divided by
    the speed and at most ``max_delay``. With a rate, releases are at least
    1/rate apart. The input order is one long sequence, so it is cut into range
    parts: each part looks back within itself, and the last readable time and the
    delays of earlier parts come from a table with one row per part.
    """
    ordered = global_order(
        df.withColumn("_us", micros(parse_time(source))), [order], "_rank"
    )
    inside = Window.partitionBy("_part").orderBy("_rank")
    parts_before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last("_us", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    last_of_part = ordered.groupBy("_part").agg(
        F.max_by("_us", F.when(F.col("_us").isNotNull(), F.col("_rank"))).alias("_end")
    )
    # one row per range part
    carried = F.broadcast(
        last_of_part.select("_part", F.last("_end", ignorenulls=True).over(parts_before).alias("_carried"))
    )
    gap = F.greatest(F.lit(0.0), (F.col("_us") - F.col("_before")) / F.lit(1e6))
    delays = (
        ordered.withColumn("_seen", seen)
        .join(carried, "_part")
        .withColumn("_before", F.coalesce("_seen", "_carried"))
        .withColumn(
            "delay_s",
            F.coalesce(F.least(F.lit(float(max_delay)), gap / F.lit(max(speed, 0.01))), F.lit(0.0)),
        )
    )
    return _release(delays, inside, parts_before, rate).drop(
        "_us", "_rank", "_part", "_seen", "_before", "_carried"
    )


def _release(delays: DataFrame, inside: Window, parts_before: Window, rate: float) -> DataFrame:
    """Running sum of the delays; with a rate the recursion
    r(i) = max(r(i-1) + d(i), r(i-1) + 1/rate) is a running sum too."""
    step = F.greatest(F.col("delay_s"), F.when(F.col("_rank") > 0, 1.0 / rate).otherwise(0.0)) if rate > 0 else F.col("delay_s")
    stepped = delays.withColumn("_step", step)
    starts = (
        stepped.groupBy("_part")
        .agg(F.sum("_step").alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(parts_before), F.lit(0.0)).alias("_start"))
    )
    running = F.sum("_step").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        stepped.withColumn("_running", running)
        .join(F.broadcast(starts), "_part")
        .withColumn("release_s", F.col("_start") + F.col("_running"))
        .drop("_step", "_running", "_start")
    )
