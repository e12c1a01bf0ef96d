"""Text and number features of a posting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, TEXT_COLUMNS
from ..functions.layout import sliced_running_sum
from ..functions.scalars import col, or_blank, parse_time, strip

# bound on the share of values left in the bracket around a median
_QUANTILE_ACCURACY = 100_000


def combined_text(df: DataFrame, name: str = "combined_text") -> DataFrame:
    """Lower-case title, description and company; empty parts keep their space."""
    return df.withColumn(
        name, F.lower(F.concat_ws(" ", or_blank("title"), or_blank("description"), or_blank("company")))
    )


def event_time(df: DataFrame, source: str = "event_timestamp", name: str = "event_time") -> DataFrame:
    return df.withColumn(name, parse_time(source))


def fill_missing_text(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.fillna("", subset=present) if present else df


def exact_medians(
    df: DataFrame, columns: Sequence[str], slice_rows: int = DEFAULT.slice_rows
) -> DataFrame:
    """One row (name, median) per column, exact at any size.

    A quantile sketch brackets the middle ranks; only values inside the bracket
    (a fixed small share) are then counted and ranked, all others just counted. The
    distinct values of a bracket are ranked in slices of their order, so a column
    without repeated values is spread like any other.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    values = df.select(pairs.alias("pair")).select("pair.name", "pair.value")
    values = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    slack = 10.0 / _QUANTILE_ACCURACY
    # one row per column name
    brackets = values.groupBy("name").agg(
        F.percentile_approx("value", [0.5 - slack, 0.5 + slack], _QUANTILE_ACCURACY).alias("q"),
        F.count(F.lit(1)).alias("n"),
    )
    placed = values.join(F.broadcast(brackets), "name")
    below = F.col("value") < F.col("q")[0]
    inside = ~below & (F.col("value") <= F.col("q")[1])
    offsets = placed.groupBy("name", "n").agg(F.sum(F.when(below, 1).otherwise(0)).alias("below"))
    counts = placed.filter(inside).groupBy("name", "value").agg(F.count(F.lit(1)).alias("times"))
    summed = sliced_running_sum(counts.withColumn("upto", F.col("times")), "name", "value", ["upto"], slice_rows)
    ranked = summed.join(F.broadcast(offsets), "name").withColumn("last", F.col("below") + F.col("upto"))
    first = F.col("last") - F.col("times")
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda rank: (first <= rank) & (rank < F.col("last"))
    return ranked.groupBy("name").agg(
        (
            (F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2
        ).alias("median")
    )


def impute_median(df: DataFrame, columns: Sequence[str] | None = None, label: str = "fraudulent") -> DataFrame:
    """Fill numeric columns, the label apart, with their median, or 0 when all are NULL."""
    numeric = ("bigint", "double")
    names = list(columns) if columns is not None else [n for n, t in df.dtypes if t in numeric and n != label]
    if not names:
        return df
    medians = exact_medians(df, names).agg(
        F.map_from_entries(F.collect_list(F.struct("name", "median"))).alias("medians")
    )
    lookup = medians.scalar()
    types = dict(df.dtypes)
    filled = {}
    for name in names:
        value = F.col(name).cast("double")
        known = F.when(value.isNull() | F.isnan(value), None).otherwise(value)
        kept = F.coalesce(known, F.try_element_at(lookup, F.lit(name)), F.lit(0.0))
        filled[name] = kept.cast("double") if types[name] != "bigint" else kept
    return df.withColumns(filled)


def clean_text(c: Column | str) -> Column:
    """Lower case, letters a-z, digits and single spaces only."""
    kept = F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\s]", "")
    return strip(F.regexp_replace(kept, r"\s+", " "))


def training_text(df: DataFrame, name: str = "combined_text", columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    parts = [or_blank(c) for c in columns if c in df.columns]
    joined = F.concat_ws(" ", *parts) if parts else F.lit("")
    return df.withColumn(name, clean_text(joined))


def posting_numbers(df: DataFrame, text: str = "combined_text") -> DataFrame:
    """has_company_profile, has_salary_range and text_length; 0 for absent columns."""

    def filled(name: str) -> Column:
        if name not in df.columns:
            return F.lit(0)
        return F.when(strip(or_blank(F.col(name).cast("string"))) != "", 1).otherwise(0)

    return df.withColumns(
        {
            "has_company_profile": filled("company_profile"),
            "has_salary_range": filled("salary_range"),
            "text_length": F.length(or_blank(text)) if text in df.columns else F.lit(0),
        }
    )


def serve_time_features(df: DataFrame, text: str = "combined_text") -> DataFrame:
    """The three numbers guessed from the text alone, where the profile and the
    salary are not at hand: any text, any digit, length."""
    body = strip(F.lower(or_blank(text)))
    return df.withColumns(
        {
            "has_company_profile": F.when(body != "", 1).otherwise(0),
            "has_salary_range": F.when(body.rlike(r"\p{Nd}"), 1).otherwise(0),
            "text_length": F.length(body),
        }
    )


def training_features(df: DataFrame) -> DataFrame:
    """Missing values filled, cleaned text and the three numbers."""
    return posting_numbers(training_text(impute_median(fill_missing_text(df))))
