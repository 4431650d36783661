"""Event-time helpers. Times are TimestampType with the session pinned to UTC."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utc_datetime(value: str | datetime) -> datetime:
    """A point in time as a datetime in UTC without an offset; one without an offset is taken as UTC."""
    parsed = datetime.fromisoformat(value) if isinstance(value, str) else value
    return parsed.astimezone(UTC).replace(tzinfo=None) if parsed.tzinfo else parsed


def instant(value: str | datetime | Column) -> Column:
    """A point in time given as text, datetime or column."""
    if isinstance(value, Column):
        return value
    return F.lit(value if isinstance(value, str) else utc_datetime(value).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def plus_seconds(ts: Column, seconds: float | Column) -> Column:
    step = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return F.timestamp_micros(F.unix_micros(ts) + (step.cast("double") * 1000000).cast("long"))


def time_slice(df: DataFrame, start, end=None, ts: str = "ts") -> DataFrame:
    """Half-open slice ``[start, end)``. Tables stored by day are pruned through their ``date`` partition column too."""
    low, high = instant(start), None if end is None else instant(end)
    out = df.where(F.col(ts) >= low)
    if high is not None:
        out = out.where(F.col(ts) < high)
    return stored_days(out, low, high)


def trailing(df: DataFrame, ts: str, as_of, seconds: float) -> DataFrame:
    """The rows of ``(as_of - seconds, as_of]``, pruned like ``time_slice``."""
    high = instant(as_of)
    low = plus_seconds(high, -float(seconds))
    return stored_days(df.where((F.col(ts) > low) & (F.col(ts) <= high)), low, high)


def stored_days(df: DataFrame, low: Column | None, high: Column | None = None) -> DataFrame:
    """Only the daily partitions that two instants span, where the table has them."""
    if "date" in df.columns:
        if low is not None:
            df = df.where(F.col("date") >= F.to_date(low))
        if high is not None:
            df = df.where(F.col("date") <= F.to_date(high))
    return df


def newest_day(df: DataFrame) -> DataFrame:
    """The rows of the newest day a stored table has; a table without days as it is. Finding the day reads no column of the rows."""
    if "date" not in df.columns:
        return df
    return df.where(F.col("date") == df.agg(F.max("date").alias("date")).scalar())


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the fixed-width bucket (aligned to the epoch) that holds ``ts``."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def millis_between(earlier: Column, later: Column) -> Column:
    return F.floor(F.unix_micros(later) / 1000).cast("long") - F.floor(F.unix_micros(earlier) / 1000).cast("long")


def unit_boundaries(unit: str, earlier: Column, later: Column) -> Column:
    """Unit boundaries crossed between two instants (minute or second)."""
    width = {"second": 1, "minute": 60}[unit]
    return (F.floor(F.unix_seconds(later) / width) - F.floor(F.unix_seconds(earlier) / width)).cast("long")
