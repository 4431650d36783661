"""Cumulative counters that restart with the engine that keeps them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counter_steps(df: DataFrame, keys: Sequence[str], ts: str, counter: str, uptime: str) -> DataFrame:
    """Adds ``increase`` per reading: the growth since the previous one, or the whole value after a restart.

    Readings are compared inside days; the first reading of a day meets the last one of the day before through one
    summary row per day. The very first reading has no increase.
    """
    days = df.withColumn("day", F.to_date(ts))
    inside = Window.partitionBy(*keys, "day").orderBy(ts)
    across = Window.partitionBy(*keys).orderBy("day")
    last = days.groupBy(*keys, "day").agg(F.max_by(F.struct(counter, uptime), ts).alias("last"))
    previous = last.withColumn("carried", F.lag("last").over(across)).select(*keys, "day", "carried")
    steps = days.withColumn("before", F.lag(F.struct(counter, uptime)).over(inside)).join(previous, [*keys, "day"])
    before = F.coalesce("before", "carried")
    grown = F.when(F.col(uptime) < before[uptime], F.col(counter)).otherwise(F.col(counter) - before[counter])
    return steps.withColumn("increase", F.when(before.isNotNull(), grown)).drop("day", "before", "carried")
