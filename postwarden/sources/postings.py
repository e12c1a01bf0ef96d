"""Postings from files and requests, brought to one shape."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.scalars import non_blank, non_empty, or_blank, strip

NUMERIC_TRAINING_COLUMNS = ("job_id", "telecommuting", "has_company_logo", "has_questions", "fraudulent")


def _text_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _first_non_empty(df: DataFrame, *names: str) -> Column:
    return F.coalesce(*[non_empty(_text_or_null(df, n)) for n in names], F.lit(""))


def normalize_posting(df: DataFrame, now: Column | datetime | str | None = None) -> DataFrame:
    """id, title, description, company, timestamp from whichever aliases exist.

    An alias is chosen while it still has its spaces, so one that holds only
    spaces wins over later ones and ends up blank. A missing id becomes a hash of
    the posting, so that reading a file twice gives the same ids.
    """
    if now is None:
        fallback = F.current_timestamp().cast("string")
    else:
        fallback = now if isinstance(now, Column) else F.lit(str(now))
    title = strip(or_blank(_text_or_null(df, "title")))
    description = strip(_first_non_empty(df, "description", "job_description", "requirements"))
    company = strip(_first_non_empty(df, "company", "company_name", "company_profile"))
    stamp = non_blank(_first_non_empty(df, "timestamp", "created_at"))
    made_id = F.sha2(F.to_json(F.struct(title, description, company, or_blank(stamp))), 256)
    return df.select(
        F.coalesce(non_blank(_first_non_empty(df, "id", "job_id")), made_id).alias("id"),
        title.alias("title"),
        description.alias("description"),
        company.alias("company"),
        F.coalesce(stamp, fallback).alias("timestamp"),
    )


def read_postings_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    now: datetime | str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Postings from CSV with a header; rows without a title are dropped.

    Quoted line breaks keep a file in one task, so large inputs should come as
    many files, or with ``multi_line=False`` where texts hold no line breaks.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path if isinstance(path, str) else list(path))
    )
    return normalize_posting(raw, now).filter(F.col("title") != "")


def read_postings_jsonl(
    spark: SparkSession, path: str | Sequence[str], now: datetime | str | None = None
) -> DataFrame:
    """Postings from JSON lines; blank lines and lines that hold no object are skipped."""
    schema = schemas.extend(schemas.POSTING_ALIASES, "_bad string")
    raw = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path if isinstance(path, str) else list(path))
    )
    return normalize_posting(raw.filter(F.col("_bad").isNull()), now).filter(F.col("title") != "")


def read_training_csv(
    spark: SparkSession,
    path: str,
    numeric: Sequence[str] = NUMERIC_TRAINING_COLUMNS,
) -> DataFrame | None:
    """Labelled postings with typed numeric columns, None when there is no such file."""
    try:
        raw = (
            spark.read.option("header", True)
            .option("multiLine", True)
            .option("escape", '"')
            .csv(path)
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    typed = {n: F.col(n).try_cast("double") for n in numeric if n in raw.columns}
    if "fraudulent" in typed:
        typed["fraudulent"] = typed["fraudulent"].try_cast("int")
    return raw.withColumns(typed) if typed else raw


def analyze_request_to_posting(df: DataFrame, now: Column | datetime | str | None = None) -> DataFrame:
    """A request for analysis as a posting: requirements follow the description,
    the company text is company_info, or company_profile when that is NULL."""
    company = F.coalesce(_text_or_null(df, "company_info"), _text_or_null(df, "company_profile"))
    text = strip(
        F.concat_ws(
            " ",
            strip(or_blank(_text_or_null(df, "description"))),
            strip(or_blank(_text_or_null(df, "requirements"))),
        )
    )
    stamp = now if isinstance(now, Column) else F.lit(None if now is None else str(now)).cast("string")
    title = or_blank(_text_or_null(df, "title"))
    company = strip(or_blank(company))
    made_id = F.sha2(F.to_json(F.struct(title, text, company)), 256)
    return df.select(
        F.coalesce(non_empty(_text_or_null(df, "id")), made_id).alias("id"),
        title.alias("title"),
        text.alias("description"),
        company.alias("company"),
        F.coalesce(
            non_empty(_text_or_null(df, "timestamp")), stamp, F.current_timestamp().cast("string")
        ).alias("timestamp"),
    )
