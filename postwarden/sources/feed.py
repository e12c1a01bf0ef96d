"""Reading the predictions table forward by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def new_predictions_since(df: DataFrame, last_id: int, limit: int = 200) -> DataFrame:
    """The next page after ``last_id`` in id order. ``latest_prediction_id`` of the
    page is the next ``last_id``."""
    return df.filter(F.col("id") > last_id).orderBy("id").limit(limit)


def latest_prediction_id(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("latest_id"))
