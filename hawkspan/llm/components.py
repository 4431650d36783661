"""Connected components of a graph of any size, by alternating large and small stars.

Each step groups edges by node, takes the smallest neighbour with partial aggregation, and joins it back; a hub's edges are split by
the skew join. Every step is written to the shared folder, so plans stay short and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hawkspan.session import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Neighbours of each node hang themselves on the smallest of them: the larger neighbours (large star) or the others."""
    forward = edges.select("a", "b")
    around = forward.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else forward.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = around.join(least, "a")
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**40)))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b bigint); a component is named by its smallest node."""
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "components")
    before, found = None, _sum(now)
    while found != before and found[0]:
        after_large = stored(_star(now, True).distinct(), "components")
        now = stored(_star(after_large, False).distinct(), "components")
        before, found = found, _sum(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
