"""State of the services over a table of health samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.layout import global_order
from ..functions.scalars import micros

# Messages for unhealthy services.
KAFKA_DOWN = "Kafka Down - ingestion degraded"
SPARK_DOWN = "Spark Down - streaming inference unavailable"
DB_DOWN = "Database Disconnected - persistence degraded"
ML_DOWN = "ML Model Unloaded - fraud scoring degraded"
RECOVERING = "Recovery Mode - reconnecting services and validating stream health"


def health_status(samples: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """State per sample.

    Input: sample_at, kafka_running, db_connected, ml_loaded (booleans),
    recent_jobs (last two minutes) and kafka_lag. Without recent work the stream
    is down when the source is down or too far ahead, else idle.
    """
    kafka, db, ml = F.col("kafka_running"), F.col("db_connected"), F.col("ml_loaded")
    spark = (
        F.when(F.col("recent_jobs") > 0, "active")
        .when(~kafka | (F.col("kafka_lag") > config.down_lag), "down")
        .otherwise("idle")
    )
    staged = samples.withColumns(
        {
            "kafka": F.when(kafka, "running").otherwise("down"),
            "spark": spark,
            "db": F.when(db, "connected").otherwise("disconnected"),
            "ml": F.when(ml, "loaded").otherwise("unloaded"),
        }
    )
    messages = F.array_compact(
        F.array(
            F.when(F.col("kafka") != "running", KAFKA_DOWN),
            F.when(F.col("spark") == "down", SPARK_DOWN),
            F.when(F.col("db") != "connected", DB_DOWN),
            F.when(F.col("ml") != "loaded", ML_DOWN),
        )
    )
    return staged.withColumn("messages", messages).withColumn("degraded", F.size("messages") > 0)


def system_mode(status: DataFrame, key: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """Mode per sample: degraded while unhealthy, recovery from the first healthy
    sample after that, normal once more than 30 s have passed since.

    The last unhealthy sample decides. It is looked up inside slices of the global
    order and carried over from the slices before, so the history of a deployment
    (``key``) never lies in one task.
    """
    own = key or "_all"
    rows = status if key else status.withColumn(own, F.lit(0))
    placed = global_order(rows, [own, "sample_at"], "_place").drop("_part")
    # the sample after each one, where recovery from it would start
    after = placed.select((F.col("_place") - 1).alias("_place"), F.col(own).alias("_owner"), F.col("sample_at").alias("_next"))
    marked = placed.join(after, "_place", "left").withColumn("_slice", F.floor(F.col("_place") / F.lit(config.slice_rows)))
    next_at = F.when(F.col("_owner").eqNullSafe(F.col(own)), F.col("_next"))
    restart = F.when(F.col("degraded"), F.struct(F.col("_place").alias("place"), next_at.alias("at")))
    marked = marked.withColumn("_restart", restart)
    inside = Window.partitionBy(own, "_slice").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(own).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(own, "_slice").agg(F.max("_restart").alias("_held"))
    carried = carried.select(
        F.col(own).alias("_owner"), F.col("_slice").alias("_of"), F.last("_held", ignorenulls=True).over(before).alias("_held")
    )
    found = marked.drop("_owner").withColumn("_start", F.last("_restart", ignorenulls=True).over(inside))
    same = found[own].eqNullSafe(carried["_owner"]) & (found["_slice"] == carried["_of"])
    found = found.join(carried, same).withColumn("_start", F.coalesce("_start", "_held"))
    waited = (micros("sample_at") - micros(F.col("_start.at"))) / F.lit(1e6)
    mode = (
        F.when(F.col("degraded"), "degraded")
        .when(F.col("_start").isNull() | (waited > config.recovery_seconds), "normal")
        .otherwise("recovery")
    )
    messages = F.when(F.col("mode") == "recovery", F.array(F.lit(RECOVERING))).otherwise(F.col("messages"))
    staged = found.withColumn("mode", mode).withColumn("messages", messages)
    return staged.withColumn("degraded", F.col("mode") != "normal").select(*status.columns, "mode")
