"""Earlier and later rows of one key, paired only in thought: a key with m earlier and n later rows costs m + n rows, not m * n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkspan.session import stored

WAYS = 8  # values tried at once by each pass over the rows


def first_later(earlier: DataFrame, later: DataFrame, key: str, since: str, at: str) -> DataFrame:
    """``earlier`` with ``at``, the first time of ``later`` under the same key at or after ``since``; rows without one are left out."""
    columns = earlier.columns
    line = earlier.withColumn("when_", F.col(since)).withColumn("asks", F.lit(1)).unionByName(
        later.select(key, at, F.col(at).alias("when_"), F.lit(0).alias("asks")).distinct(), allowMissingColumns=True
    )
    back = Window.partitionBy(key).orderBy(F.desc("when_"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line.withColumn(at, F.last(at, ignorenulls=True).over(back)).where((F.col("asks") == 1) & F.col(at).isNotNull()).select(*columns, at)


def _running(questions: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """``questions`` (key, us, ...) with ``before``, the number of ``marks`` (key, us, n) of the same key at smaller ``us``."""
    line = questions.withColumn("n", F.lit(0).cast("long")).withColumn("asks", F.lit(0)).unionByName(marks.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("us", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line.withColumn("before", F.sum("n").over(upto)).where(F.col("asks") == 0).drop("n", "asks")


def median_later(earlier: DataFrame, later: DataFrame, key: str, since: str, origin: str, at: str) -> Column:
    """The interpolated median of the whole milliseconds from ``origin`` to ``at`` over all pairs of a key with ``at`` >= ``since``; NULL without pairs.

    The number of pairs up to a value is a sum of differences of counts, so the middle values are found by halving (by ``WAYS + 1``) the
    span of values: some ten passes over the rows, each of which brings ``WAYS`` sums to the driver.
    """
    marks = stored(later.groupBy(key, F.unix_micros(at).alias("us")).agg(F.count("*").alias("n")), "marks")
    starts = earlier.groupBy(key, F.unix_micros(since).alias("us"), F.floor(F.unix_micros(origin) / 1000).alias("origin")).agg(F.count("*").alias("weight"))
    starts = stored(_running(starts, marks, key).select(key, "origin", "weight", F.col("before").alias("base")), "starts")
    first, last = marks.agg(F.min("us"), F.max("us")).head()
    low, high = starts.agg(F.min("origin"), F.max("origin")).head()
    if first is None or low is None:
        return F.lit(None).cast("double")

    def pairs_upto(values: list[int]) -> dict[int, int]:
        asked = starts.withColumn("value", F.explode(F.array(*[F.lit(v).cast("long") for v in values]))).withColumn("us", (F.col("origin") + F.col("value") + 1) * 1000)
        sums = _running(asked, marks, key).groupBy("value").agg(F.sum(F.col("weight") * F.greatest(F.col("before") - F.col("base"), F.lit(0))).alias("pairs"))
        return {r["value"]: r["pairs"] for r in sums.collect()}

    bottom, top = first // 1000 - high - 1, last // 1000 - low
    known = {bottom: 0} | pairs_upto([top])
    total = known[top]
    if total == 0:
        return F.lit(None).cast("double")

    def ranked(rank: int) -> int:
        """The smallest value up to which there are ``rank`` pairs."""
        while True:
            below, reached = max(v for v, n in known.items() if n < rank), min(v for v, n in known.items() if n >= rank)
            if reached - below == 1:
                return reached
            known.update(pairs_upto(sorted({below + (reached - below) * i // (WAYS + 1) for i in range(1, WAYS + 1)} - {below})))

    return F.lit((ranked((total + 1) // 2) + ranked(total // 2 + 1)) / 2)
