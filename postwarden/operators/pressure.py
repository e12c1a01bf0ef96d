"""Cluster pressure and the score corrections it causes."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.layout import sliced_running_sum, split_join
from ..functions.scalars import clamp01, clock, count_if, from_micros, hours, micros, safe_double, safe_int
from ..session import cut_lineage
from .records import INCREASE, UPGRADE
from .rules import base_score

_HOUR_US = 3_600_000_000


def cluster_pressure(members: DataFrame, as_of: Column | datetime | str | None = None) -> DataFrame:
    """Per cluster the members of the last 1, 6 and 24 hours (edges excluded) and
    ln(members of 24 h + 1)."""
    now = clock(members, "created_at", as_of)
    newer = lambda n: F.col("created_at") > now - hours(n)
    return (
        members.filter(F.col("created_at") <= now)
        .groupBy("cluster_id")
        .agg(
            count_if(newer(1)).alias("count_1h"),
            count_if(newer(6)).alias("count_6h"),
            count_if(newer(24)).alias("count_24h"),
        )
        .withColumn("pressure_score", F.log1p("count_24h"))
    )


def high_pressure_clusters(members: DataFrame, as_of: Column | datetime | str | None = None) -> DataFrame:
    """How many clusters have a pressure above 1 (24 h edge included)."""
    now = clock(members, "created_at", as_of)
    recent = members.filter(F.col("created_at").between(now - hours(24), now)).groupBy("cluster_id")
    return (
        recent.agg(F.count(F.lit(1)).alias("n"))
        .filter(F.log1p("n") > 1.0)
        .agg(F.count(F.lit(1)).alias("high_pressure_clusters"))
    )


def pressure_timeline(members: DataFrame, config: Config = DEFAULT, slice_name: str | None = None) -> DataFrame:
    """Per cluster and time of insertion, the members of the trailing 1, 6 and 24 h, and
    as ``slice_name``, if asked, a part of the cluster's history of a bounded size.

    Each member counts from its insertion until exactly n hours later, so the
    counts are running sums of entries and exits. Equal times are added up first;
    histories are summed in time slices, so no cluster needs one task.
    Rows of one instant see each other.
    """
    inserts = members.groupBy("cluster_id", "created_at").agg(F.count(F.lit(1)).alias("n"))
    us, n, none = micros("created_at"), F.col("n"), F.lit(0).cast("bigint")

    def step(shift: int, *signs: int) -> Column:
        parts = [(n * s if s else none).alias(f"count_{h}h") for s, h in zip(signs, (1, 6, 24))]
        return F.struct((us + shift * _HOUR_US).alias("us"), *parts, F.lit(shift == 0).alias("entry"))

    steps = inserts.select(
        "cluster_id",
        F.inline(F.array(step(0, 1, 1, 1), step(1, -1, 0, 0), step(6, 0, -1, 0), step(24, 0, 0, -1))),
    )
    counts = ["count_1h", "count_6h", "count_24h"]
    instants = steps.groupBy("cluster_id", "us").agg(
        *[F.sum(c).alias(c) for c in counts], F.max("entry").alias("entry")
    )
    timed = instants.withColumn("created_at", from_micros(F.col("us"))).drop("us")
    running = sliced_running_sum(timed, "cluster_id", "created_at", counts, config.slice_rows, slice_name)
    return running.filter("entry").select(
        "cluster_id", "created_at", *counts, F.log1p("count_24h").alias("pressure_score"),
        *([slice_name] if slice_name else []),
    )


def pressure_at_insert(members: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Each membership with the pressure of its cluster at its own insertion."""
    keys = ["cluster_id", "created_at"]
    return split_join(members, pressure_timeline(members, config), keys, hot_key_rows=config.hot_key_rows)


def correction_targets(predictions: DataFrame, pressure: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """All predictions of a cluster next to its pressure."""
    return split_join(predictions, pressure, ["cluster_id"], hot_key_rows=config.hot_key_rows)


def correction_reason(cluster: Column, count_1h: Column, count_24h: Column, pressure: Column) -> Column:
    # Fixed value: wording of the explanation.
    return F.format_string(
        "Fraud escalation detected:\n"
        "- %d similar jobs detected in 1 hour\n"
        "- Pattern repetition confirmed\n"
        "- Cluster risk threshold exceeded (cluster=%s, pressure=%.2f, 24h=%d)",
        count_1h,
        cluster,
        pressure,
        count_24h,
    )


def _summary(kind: Column, reason: Column) -> Column:
    prefix = F.when(kind == UPGRADE, "UPDATED FRAUD DETECTION: ").otherwise("UPDATED RISK ESCALATION: ")
    return F.concat(prefix, F.replace(reason, F.lit("\n"), F.lit(" ")))


def _base() -> Column:
    return clamp01(safe_double("original_score", base_score()))


def _judged(
    predictions: DataFrame,
    members: DataFrame,
    as_of: Column | datetime | str | None,
    config: Config,
    how: str,
) -> DataFrame:
    """Predictions with their new values in ``_`` columns; ``_changes`` tells which
    rows the present pressure corrects."""
    pressure = cluster_pressure(members, as_of)
    previous = safe_int("prediction")
    staged = (
        split_join(predictions, pressure, ["cluster_id"], how, config.hot_key_rows)
        .withColumn("_base", _base())
        .withColumn(
            "_new", F.least(F.lit(1.0), F.col("_base") + F.col("pressure_score") * config.pressure_multiplier)
        )
        .withColumn("old_score", safe_double("updated_score", F.col("_base")))
        .withColumn("_class", F.when(F.col("pressure_score") > config.hard_flip, 1).otherwise(previous))
    )
    settled = (
        F.coalesce("is_corrected", F.lit(False))
        & (F.abs(F.col("_new") - F.col("old_score")) < 1e-9)
        & (previous == F.col("_class"))
    )
    enough = F.col("_new") - F.col("_base") > config.correction_delta
    changes = F.coalesce(enough & (F.trim("job_id") != "") & ~settled, F.lit(False))
    flips = (F.col("pressure_score") > config.hard_flip) & (previous != 1)
    return staged.withColumns(
        {
            "_changes": changes,
            "correction_type": F.when(flips, UPGRADE).otherwise(INCREASE),
            "_why": correction_reason(
                F.col("cluster_id"), F.col("count_1h"), F.col("count_24h"), F.col("pressure_score")
            ),
        }
    )


def _new_values() -> dict[str, Column]:
    return {
        "updated_score": F.col("_new"),
        "is_corrected": F.lit(True),
        "version": F.coalesce("version", F.lit(1)) + 1,
        "prediction": F.col("_class"),
        "reason": _summary(F.col("correction_type"), F.col("_why")),
        "correction_reason": F.col("_why"),
    }


def apply_corrections(
    predictions: DataFrame,
    members: DataFrame,
    as_of: Column | datetime | str | None = None,
    config: Config = DEFAULT,
) -> DataFrame:
    """New versions of the predictions that the present pressure corrects.

    All input columns, updated, plus ``old_score`` and ``correction_type`` for the
    audit table. Rows that stay as they are do not appear; ``latest_versions``
    merges the result with the stored table.
    """
    changed = _judged(predictions, members, as_of, config, "inner").filter("_changes")
    return changed.withColumns(_new_values()).select(*predictions.columns, "old_score", "correction_type")


def corrected_table(
    predictions: DataFrame,
    members: DataFrame,
    as_of: Column | datetime | str | None = None,
    config: Config = DEFAULT,
) -> DataFrame:
    """The whole predictions table after the present corrections, in one pass."""
    judged = _judged(predictions, members, as_of, config, "left")
    new = {c: F.when(F.col("_changes"), v).otherwise(F.col(c)) for c, v in _new_values().items()}
    return judged.withColumns(new).select(*predictions.columns)


def correction_events(corrected: DataFrame, as_of: Column) -> DataFrame:
    """Audit rows of ``apply_corrections``."""
    return corrected.select(
        "job_id",
        "old_score",
        F.col("updated_score").alias("new_score"),
        F.col("correction_reason").alias("reason"),
        "correction_type",
        as_of.alias("updated_at"),
    )


def latest_versions(predictions: DataFrame, changed: DataFrame) -> DataFrame:
    """The predictions table after corrections: the highest version per job.

    ``changed`` holds later versions, any number per job. Only keys and versions
    are compared, so unused columns are never read.
    """
    newest = changed.groupBy("job_id").agg(F.max("version").alias("version"))
    kept = changed.join(newest, ["job_id", "version"], "left_semi").select(*predictions.columns)
    return predictions.join(newest, "job_id", "left_anti").unionByName(kept)


def _levels(config: Config) -> int:
    """Members beyond this number change neither a score nor a class: the score has
    reached 1 from any base, and the hard flip has happened."""
    full = math.ceil(math.exp(1.0 / config.pressure_multiplier) - 1.0)
    flip = math.floor(math.exp(config.hard_flip) - 1.0) + 1
    return max(full, flip)


def correction_history(predictions: DataFrame, members: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every correction that inserting the members one after another would emit.

    Each insertion looks at all postings of its cluster again, yet only a change
    of pressure below saturation alters a score. So the insertions of a cluster
    shrink to waves, the instants where the capped level changes: few per day and
    cluster however many members it has. A posting meets its own insertion and
    the later waves; steps that leave it as it was are dropped.
    """
    cap = _levels(config)
    # read twice below, and narrow next to what it is made from; its slices are those of the
    # running sums, so it is not put in order again
    timeline = cut_lineage(pressure_timeline(members, config, "_slice"))
    slices = timeline.withColumn("level", F.least(F.lit(cap), F.col("count_24h")))
    order = Window.partitionBy("cluster_id", "_slice").orderBy("created_at")
    # the first instant of a slice is kept as a wave; a repeated level does no harm
    waves = (
        slices.withColumn("_last", F.lag("level").over(order))
        .filter(F.col("_last").isNull() | (F.col("_last") != F.col("level")))
        .select(
            "cluster_id",
            F.col("created_at").alias("updated_at"),
            "count_1h",
            "count_24h",
            "pressure_score",
        )
    )
    jobs = predictions.select(
        "job_id",
        "cluster_id",
        "created_at",
        _base().alias("base"),
        safe_double("updated_score", _base()).alias("start_score"),
        safe_int("prediction").alias("start_class"),
        F.coalesce("is_corrected", F.lit(False)).alias("start_corrected"),
    )
    # a base from which no pressure reaches the delta never takes part
    jobs = jobs.filter(1.0 - F.col("base") > config.correction_delta)
    own = split_join(
        jobs,
        timeline.select("cluster_id", "created_at", "count_1h", "count_24h", "pressure_score"),
        ["cluster_id", "created_at"],
        hot_key_rows=config.hot_key_rows,
    ).withColumn("updated_at", F.col("created_at"))
    later = split_join(jobs, waves, ["cluster_id"], hot_key_rows=config.hot_key_rows).filter(
        F.col("updated_at") > F.col("created_at")
    )
    new = F.least(F.lit(1.0), F.col("base") + F.col("pressure_score") * config.pressure_multiplier)
    steps = (
        own.unionByName(later)
        .withColumn("new_score", new)
        .withColumn("hard", F.col("pressure_score") > config.hard_flip)
        .filter(F.col("new_score") - F.col("base") > config.correction_delta)
    )
    # per posting: its own step and at most the waves of its cluster
    per_job = Window.partitionBy("job_id", "cluster_id", "created_at").orderBy("updated_at")
    before = per_job.rowsBetween(Window.unboundedPreceding, -1)
    flipped = F.coalesce(F.max("hard").over(before), F.lit(False))
    traced = (
        steps.withColumn("old_score", F.coalesce(F.lag("new_score").over(per_job), F.col("start_score")))
        .withColumn("seen", F.lag("new_score").over(per_job).isNotNull() | F.col("start_corrected"))
        .withColumn("old_class", F.when(flipped, 1).otherwise(F.col("start_class")))
    )
    flips = F.col("hard") & (F.col("old_class") != 1)
    same = F.col("seen") & (F.abs(F.col("new_score") - F.col("old_score")) < 1e-9) & ~flips
    return traced.filter(~same).select(
        "job_id",
        "cluster_id",
        "old_score",
        "new_score",
        correction_reason(
            F.col("cluster_id"), F.col("count_1h"), F.col("count_24h"), F.col("pressure_score")
        ).alias("reason"),
        F.when(flips, UPGRADE).otherwise(INCREASE).alias("correction_type"),
        "updated_at",
    )
