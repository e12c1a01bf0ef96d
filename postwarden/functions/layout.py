"""Ways to keep one hot key, one time slice or one long order from landing in
one task: a global order from a range shuffle, running sums in two levels, and
joins that split only the keys that need it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT
from ..session import cut_lineage

_ROW_BITS = (1 << 33) - 1


def global_order(df: DataFrame, keys: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Add the zero-based position of each row in the order of ``keys``.

    A range shuffle spreads rows evenly even when one time stamp holds many of
    them (the keys must end in a unique one); positions come from the row index
    inside each sorted part plus the sizes of the parts before it. The parts are
    written once, as a second evaluation could cut them elsewhere. Also
    adds ``_part`` for two-level folds over the same order.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    parts = cut_lineage(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_index", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition, so neither the window nor the broadcast grows with the data
    starts = (
        parts.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    return (
        parts.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_index"))
        .drop("_start", "_index")
    )


def sliced_running_sum(
    df: DataFrame,
    key: str,
    time: str,
    values: Sequence[str],
    slice_rows: int = DEFAULT.slice_rows,
    slice_name: str | None = None,
) -> DataFrame:
    """Replace ``values`` by their running sums per key in time order, and add the number
    of the slice as ``slice_name`` if asked.

    Needs one row per (key, time). The global order is cut into slices of equal
    length, which are summed apart for each key; the sums of earlier slices come
    from a table with one row per key and slice, so a hot key or instant is spread.
    """
    placed = global_order(df, [key, time], "_place").drop("_part")
    cut = placed.withColumn("_slice", F.floor(F.col("_place") / F.lit(slice_rows))).drop("_place")
    within = Window.partitionBy(key, "_slice").orderBy(time)
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(key, "_slice")
        .agg(*[F.sum(v).alias(f"_in_{v}") for v in values])
        .select(
            key,
            "_slice",
            *[F.coalesce(F.sum(f"_in_{v}").over(earlier), F.lit(0)).alias(f"_in_{v}") for v in values],
        )
    )
    running = cut.select(
        *[c for c in cut.columns if c not in values],
        *[F.sum(v).over(within).alias(v) for v in values],
    )
    joined = running.join(carried, [key, "_slice"])
    return joined.select(
        *[c for c in df.columns if c not in values],
        *[(F.col(v) + F.col(f"_in_{v}")).alias(v) for v in values],
        *([F.col("_slice").alias(slice_name)] if slice_name else []),
    )


def sliced_last(
    df: DataFrame, key: str, order: Sequence[Column | str], value: str, name: str, slice_rows: int = DEFAULT.slice_rows
) -> DataFrame:
    """Add ``name``, the last ``value`` that is not null before each row of a key.

    The order must end in something unique. As for sums, slices of the global order are
    searched apart and take over what the slices before them hold last.
    """
    placed = global_order(df, [key, *order], "_place").drop("_part")
    cut = placed.withColumn("_slice", F.floor(F.col("_place") / F.lit(slice_rows)))
    within = Window.partitionBy(key, "_slice").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_place")))
    carried = cut.groupBy(key, "_slice").agg(newest.alias("_newest"))
    carried = carried.select(key, "_slice", F.last("_newest", ignorenulls=True).over(earlier).alias("_newest"))
    found = cut.withColumn(name, F.last(value, ignorenulls=True).over(within)).join(carried, [key, "_slice"])
    return found.withColumn(name, F.coalesce(name, "_newest")).drop("_newest", "_slice", "_place")


def split_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_key_rows: int = DEFAULT.hot_key_rows,
) -> DataFrame:
    """Equi join whose left side may hold a large share of its rows under one key.

    Keys with more than ``hot_key_rows`` left rows are spread over as many salts
    as they need and their right rows are copied to each salt; all other keys
    take salt 0. At most rows / hot_key_rows keys are hot, which bounds the
    broadcast table.
    """
    keys = list(on)
    hot = (
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_key_rows)
        .select(*keys, F.ceil(F.col("_n") / F.lit(hot_key_rows)).cast("int").alias("_salts"))
    )
    salts = F.coalesce("_salts", F.lit(1))
    salted = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int"))
        .drop("_salts")
    )
    copied = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")
