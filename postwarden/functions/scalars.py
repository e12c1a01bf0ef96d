"""Column helpers shared by the operators; all run inside generated code."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

# Accepted time text, white space and boolean words.
ISO_TIME = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
TRUE_WORDS = ("1", "true", "yes", "on")
FALSE_WORDS = ("0", "false", "no", "off")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Drop leading and trailing white space of any kind."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def has_text(c: Column | str) -> Column:
    """Anything but white space; stops at the first such character."""
    return F.coalesce(col(c).rlike(r"\S"), F.lit(False))


def non_blank(c: Column | str) -> Column:
    """Stripped text, NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def non_empty(c: Column | str) -> Column:
    """The text as is, NULL when it has no characters."""
    return F.nullif(col(c), F.lit(""))


def or_blank(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def safe_double(c: Column | str, fallback: Column | float = 0.0) -> Column:
    """Number or the fallback for NULL, NaN and text that is no number."""
    other = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    value = col(c).try_cast("double")
    return F.when(value.isNull() | F.isnan(value), other).otherwise(value)


def safe_int(c: Column | str, fallback: int = 0) -> Column:
    """Whole number, cut toward zero, or the fallback."""
    value = col(c).try_cast("double")
    whole = F.when(F.isnan(value), None).otherwise(value).try_cast("int")
    return F.coalesce(whole, F.lit(fallback))


def safe_bool(c: Column | str, fallback: bool = False) -> Column:
    word = F.lower(strip(col(c).cast("string")))
    return (
        F.when(word.isin(*TRUE_WORDS), True)
        .when(word.isin(*FALSE_WORDS), False)
        .otherwise(F.lit(fallback))
    )


def parse_time(c: Column | str) -> Column:
    """ISO text to a timestamp; text without zone is UTC, anything else NULL."""
    text = strip(c)
    return F.when(text.rlike(ISO_TIME), F.try_to_timestamp(text))


def ntz(c: Column | str) -> Column:
    return col(c).cast("timestamp_ntz")


def micros(c: Column | str) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' HOUR")


def minutes(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' MINUTE")


def as_time(value: Column | datetime | str) -> Column:
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def clock(df: DataFrame, column: str, as_of: Column | datetime | str | None) -> Column:
    """The instant a report is drawn for: the argument, else the newest time in
    ``df`` as a one-value subquery. Pass a literal where possible, so that the
    time filters reach the files."""
    if as_of is not None:
        return as_time(as_of)
    return df.agg(ntz(F.max(column)).alias("as_of")).scalar()


def hour_start(c: Column | str) -> Column:
    return ntz(F.date_trunc("hour", col(c)))


def is_one(c: Column | str) -> Column:
    return F.coalesce(col(c) == 1, F.lit(False))


def count_if(condition: Column) -> Column:
    """Rows where the condition holds, 0 for none."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")
