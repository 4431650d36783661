"""Gaps between events and exact medians per group, for groups of any size.

A single pair of hosts may own a third of all rows, so nothing here puts one group's rows into one task:

* events are first counted per (group, timestamp), then compared inside one-minute slices; the gaps that cross
  slices come from the slice edges, of which a group has at most one per minute;
* medians work on counted distinct values: a logarithmic histogram (a bounded number of cells per group) finds the
  cell that holds the wanted rank, and only that cell's values are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkspan.session import stored

SLICE_SECONDS = 60
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)  # by rows: equal values may come in several rows
CELL_BITS = 14  # 2^14 cells per power of two: a cell of values near v holds at most v / 2^14 distinct values


def event_gaps(events: DataFrame, keys: Sequence[str], micros: str, weight: str, slice_seconds: int = SLICE_SECONDS, span: int | None = None) -> DataFrame:
    """Counted gaps ``keys, gap, n`` (µs) between consecutive events; ``weight`` counts events at one instant.

    With ``span``, gaps are counted by the periods of so many seconds in which they begin and end, too (``since``, ``until``).
    """
    per_instant = events.groupBy(*keys, micros).agg(F.sum(weight).alias("n")).withColumn("part", F.floor(F.col(micros) / (slice_seconds * 1000000)))
    inside = per_instant.withColumn("before", F.lag(micros).over(Window.partitionBy(*keys, "part").orderBy(micros)))
    edges = per_instant.groupBy(*keys, "part").agg(F.min(micros).alias("head"), F.max(micros).alias("tail"))
    across = edges.withColumn("before", F.lag("tail").over(Window.partitionBy(*keys).orderBy("part")))
    once = F.lit(1).cast("long").alias("n")
    steps = inside.select(*keys, "before", F.col(micros).alias("after"), once).unionByName(across.select(*keys, "before", F.col("head").alias("after"), once))
    steps = steps.where(F.col("before").isNotNull()).unionByName(
        per_instant.where(F.col("n") > 1).select(*keys, F.col(micros).alias("before"), F.col(micros).alias("after"), (F.col("n") - 1).alias("n"))
    )
    periods = [F.floor(F.col(c) / (span * 1000000)).alias(a) for c, a in (("before", "since"), ("after", "until"))] if span else []
    gaps = steps.select(*keys, (F.col("after") - F.col("before")).alias("gap"), "n", *periods)
    return counted(gaps, [*keys, "since", "until"] if span else keys, "gap", F.col("n"))


def frequent(rows: DataFrame, often: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the groups in ``often``. Those are few, so the join drops the others before any sort."""
    return rows.join(often.select(*keys).distinct(), list(keys), "left_semi")


def counted(df: DataFrame, keys: Sequence[str], value: str, n: Column) -> DataFrame:
    """Distinct values per group with how often they occur (combined before the shuffle)."""
    return df.groupBy(*keys, value).agg(F.sum(n).alias("n"))


def _cell(value: Column) -> Column:
    """Order-preserving logarithmic cell number of a non-negative whole number."""
    exponent = F.greatest(F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double"))) - CELL_BITS, F.lit(0)).cast("int")
    return exponent.cast("long") * (1 << (CELL_BITS + 2)) + F.floor(value / F.pow(F.lit(2.0), exponent)).cast("long")


def grouped_median(values: DataFrame, keys: Sequence[str], value: str, kind: str = "upper", min_count: int = 1, alias: str = "median") -> DataFrame:
    """Exact median ``keys, total, <alias>`` of counted values (columns ``value`` ≥ 0 and ``n``).

    ``upper`` takes the upper of the two middle elements, ``midpoint`` their mean. Groups with fewer than
    ``min_count`` values are left out as soon as their size is known.
    """
    celled = values.withColumn("cell", _cell(F.col(value)))
    cells = celled.groupBy(*keys, "cell").agg(F.sum("n").alias("in_cell"))
    group = Window.partitionBy(*keys)
    placed = cells.select(*keys, "cell", "in_cell", F.sum("in_cell").over(group.orderBy("cell").rowsBetween(*UP_TO_HERE)).alias("upto"), F.sum("in_cell").over(group).alias("total"))
    high = F.floor(F.col("total") / 2) + 1
    low = high if kind == "upper" else F.floor((F.col("total") + 1) / 2)
    wanted = (
        placed.where(F.col("total") >= min_count).withColumn("low", low).withColumn("high", high)
        .withColumn("before", F.col("upto") - F.col("in_cell"))
        .where((F.col("upto") >= F.col("low")) & (F.col("before") < F.col("high")))
        .select(*keys, "cell", "total", "low", "high", "before")
    )
    ranked = celled.join(wanted, [*keys, "cell"]).withColumn(
        "upto", F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "cell").orderBy(value).rowsBetween(*UP_TO_HERE))
    )
    picked = ranked.groupBy(*keys).agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") >= F.col("low"), F.col(value))).alias("lo"),
        F.max(F.when(F.col("upto") - F.col("n") < F.col("high"), F.col(value))).alias("hi"),
    )
    middle = F.col("hi") if kind == "upper" else (F.col("lo") + F.col("hi")) / 2
    return picked.select(*keys, "total", middle.alias(alias))


def attach(values: DataFrame, per_group: DataFrame, keys: Sequence[str], spread: str, salts: int = 16) -> DataFrame:
    """Join one row per group to the group's rows, spreading every group over ``salts`` tasks by the column ``spread``.

    The hint keeps the copies off the driver: Spark guesses the size of ``per_group`` as if it were not repeated ``salts`` times.
    """
    salted = values.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*keys, "salt"]).drop("salt")


def measure_table(events: DataFrame, keys: Sequence[str], micros: str, weight: str, size: str | None = None) -> DataFrame:
    """Everything a regularity score needs, as one narrow stored table ``keys, value, n, kind``.

    Kinds: ``gap`` and ``size`` are counted distinct values, ``first`` and ``last`` the group's time span. The counted events are
    written once; the measures and the scores work on what was written. Give it the events of frequent groups only.
    """
    measured = [micros, *([size] if size else [])]
    events = stored(events.groupBy(*keys, *measured).agg(F.sum(weight).alias(weight)), "instants")
    return stored(_measures(events, keys, micros, weight, size), "measures", "kind")


def _measures(events: DataFrame, keys: Sequence[str], micros: str, weight: str, size: str | None) -> DataFrame:
    span = events.groupBy(*keys).agg(F.min(micros).alias("first"), F.max(micros).alias("last"), F.sum(weight).alias("n"))
    parts = {"gap": event_gaps(events, keys, micros, weight).withColumnRenamed("gap", "value")}
    if size:
        parts["size"] = counted(events, keys, size, F.col(weight)).withColumnRenamed(size, "value")
    return _kinds(parts, span, keys)


def _kinds(parts: dict[str, DataFrame], span: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = span.select(*keys, "n", F.expr("stack(2, 'first', first, 'last', last) AS (kind, value)")).select(*keys, "value", "n", "kind")
    for kind, part in parts.items():
        out = out.unionByName(part.select(*keys, "value", "n", F.lit(kind).alias("kind")))
    return out


def sliding_measure_table(rows: DataFrame, keys: Sequence[str], micros: str, size: str, scope) -> DataFrame:
    """The measures of every window of ``scope`` (hourly windows), keyed by ``window_end`` and ``keys``.

    Gaps are taken once for all windows: two events that follow each other do so in every window that holds both, so a gap counts in
    the windows that hold its two hours. Only groups with a connection that some of its windows leave out are taken window by window.
    """
    hour = F.floor(F.col(micros) / (3600 * 1000000)).alias("pane")
    window_keys = [*scope.keys, *keys]
    left_out = F.coalesce("left_out", F.array().cast("array<bigint>")) if "left_out" in rows.columns else F.array().cast("array<bigint>")
    events = rows.select(*keys, micros, size, hour, left_out.alias("left_out"))
    events = events.withColumn("left_out", F.array_intersect("left_out", scope.ends_of("pane", "pane"))).where(F.size(F.array_except(scope.ends_of("pane", "pane"), "left_out")) > 0)
    events = stored(events.groupBy(*keys, micros, size, "pane", "left_out").agg(F.count("*").alias("n")), "instants")
    changing = events.where(F.size("left_out") > 0).select(*keys).distinct()
    steady = events.join(changing, list(keys), "left_anti").drop("left_out")

    gaps = event_gaps(steady, keys, micros, "n", span=3600).withColumnRenamed("gap", "value")
    sizes = counted(steady, [*keys, "pane"], size, F.col("n")).withColumnRenamed(size, "value")
    spans = steady.groupBy(*keys, "pane").agg(F.min(micros).alias("first"), F.max(micros).alias("last"), F.sum("n").alias("n"))
    spans = scope.spread(spans, scope.ends_of("pane", "pane")).groupBy(*window_keys).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    parts = {"gap": scope.spread(gaps, scope.ends_of("since", "until")), "size": scope.spread(sizes, scope.ends_of("pane", "pane"))}
    by_window = scope.spread(events.join(changing, list(keys), "left_semi"), scope.ends_of("pane", "pane"))
    return stored(_kinds(parts, spans, window_keys).unionByName(_measures(by_window, window_keys, micros, "n", size)), "measures", "kind")


def by_kind(df: DataFrame, keys: Sequence[str], **columns: tuple[str, str]) -> DataFrame:
    """One row per group from rows per (group, kind): ``alias=(kind, column)``."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(a) for a, (k, c) in columns.items()])
