"""Small deterministic samples of distinct values, latest rows per key and guarded ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smallest_distinct(df: DataFrame, keys: Sequence[str], value: Column, size: int, alias: str) -> DataFrame:
    """``keys, alias``: the ``size`` smallest distinct values per group, sorted.

    The rank limit is pushed below the shuffle, so no task ever holds more than ``size`` values of a group per input task.
    """
    distinct = df.select(*keys, value.alias("pick")).where(F.col("pick").isNotNull()).distinct()
    kept = distinct.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("pick"))).where(F.col("place") <= size)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list("pick")).alias(alias))


def latest_per_key(df: DataFrame, keys: Sequence[str], when: str, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The columns of the newest row per key; NULLs of that row are kept. ``tie`` breaks equal times."""
    order = F.struct(when, *[c for c in tie if c != when])
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*columns, F.col(when).alias("latest_at")), order).alias("row"))
    return newest.select(*keys, "row.*")


def share(part: Column, whole: Column) -> Column:
    """Ratio with the denominator floored at one."""
    return part / F.greatest(whole, F.lit(1))


def any_text(value: Column) -> Column:
    """A stable stand-in for "any non-empty value": the smallest one, '' when there is none."""
    return F.coalesce(F.min(F.when(value != "", value)), F.lit(""))
