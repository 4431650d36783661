"""Pairs of earlier and later rows against making every pair."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from hawkspan.operators.later import first_later, median_later


def tables(spark, seed, keys):
    rng = random.Random(seed)
    earlier = [(f"k{rng.randrange(keys)}", rng.randrange(5000), rng.randrange(9000)) for _ in range(300)]
    later = [(f"k{rng.randrange(keys)}", rng.randrange(6000)) for _ in range(400)]
    millis = {c: F.timestamp_micros((F.col(c) * 370).cast("long")) for c in ("since", "origin", "at")}
    return earlier, later, spark.createDataFrame(earlier, "key string, since long, origin long").withColumns({c: millis[c] for c in ("since", "origin")}), spark.createDataFrame(later, "key string, at long").withColumns({"at": millis["at"]})


@pytest.mark.parametrize("seed, keys", [(1, 1), (2, 7), (3, 3000)])
def test_the_median_of_all_pairs_without_pairs(spark, seed, keys):
    earlier, later, left, right = tables(spark, seed, keys)
    spans = [a * 370 // 1000 - o * 370 // 1000 for k, s, o in earlier for j, a in later if j == k and a >= s]
    got = spark.range(1).select(median_later(left, right, "key", "since", "origin", "at").alias("m")).head()["m"]
    assert got == (statistics.median(spans) if spans else None)
    first = sorted((r.key, r.since, r.origin, r["at"]) for r in first_later(left, right, "key", "since", "at").collect())
    joined = left.join(right, "key").where("at >= since").groupBy("key", "since", "origin").agg(F.min("at").alias("at"))
    assert sorted(set(first)) == sorted((r.key, r.since, r.origin, r["at"]) for r in joined.collect())


def test_a_busy_key_makes_no_pairs(spark):
    """200,000 blocks and 200,000 applications of one address are 20,000,100,000 pairs."""
    left = spark.range(200000).select(F.lit("k").alias("key"), F.timestamp_millis("id").alias("since"), F.timestamp_millis("id").alias("origin"))
    right = spark.range(200000).select(F.lit("k").alias("key"), F.timestamp_millis("id").alias("at"))
    got = spark.range(1).select(median_later(left, right, "key", "since", "origin", "at").alias("m")).head()["m"]
    half, counted = 200000 * 200001 // 2 // 2, 0  # a span of d milliseconds comes 200000 - d times
    for d in range(200000):
        counted += 200000 - d
        if counted > half:
            break
    assert abs(got - d) <= 0.5
