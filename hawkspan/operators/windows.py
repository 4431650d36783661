"""The windows a detection judges: a single one, or every full hour's trailing window at once.

A detection asks its scope for rows and for grouped measures. With one window that is a filter and a plain grouping. With many, rows are
first reduced to panes, one partial state per key and hour; a pane is then handed to the window ends it belongs to and the states are
merged, with the window's end as one more column. Each table is read once however many windows there are, and a row is counted once.
Counts of key combinations (``counted_where_many``) are kept running instead, so that no pane is repeated for its windows.
Windows and panes begin on full hours, so a pane lies wholly inside a window or wholly outside.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkspan.functions.times import instant, plus_seconds, time_slice, utc_datetime
from hawkspan.operators.allowlist import excepted_names, without_excepted_connections

HOUR = 3600
SPAN = 7  # lengths of a window that a block of time has; of each block but its last rows are there twice
MERGE = {"sum": F.sum, "min": F.min, "max": F.max, "bits": F.bit_or}
Measures = Mapping[str, tuple[str, Column]]
Step = Callable[[DataFrame], DataFrame]


def hour_of(ts: str | Column) -> Column:
    """Number of the hour since the epoch that holds ``ts``."""
    return F.floor(F.unix_seconds(ts) / HOUR).cast("long")


@dataclass(frozen=True)
class OneWindow:
    """``[start, end)``; bounds are text, datetimes or columns."""

    start: object
    end: object
    keys: tuple[str, ...] = ()

    @property
    def opens(self) -> Column:
        return instant(self.start)

    def rows(self, df: DataFrame, before: float = 0.0, ts: str = "ts") -> DataFrame:
        """The rows of the window and of ``before`` seconds ahead of it."""
        return time_slice(df, plus_seconds(instant(self.start), -before) if before else self.start, self.end, ts)

    def grouped(
        self, rows: DataFrame, keys: Sequence[str], measures: Measures, until: str | None = None, before: int = 0, each: Step | None = None, together: Sequence[str] = (),
    ) -> DataFrame:
        """One row per group. Of rows with an end of their own (``until``) those count that reach into the window.

        ``each`` is done to the groups, or to the panes before they are handed out to windows: it may drop rows and add columns by their
        keys. Panes of equal ``together`` lie in one partition when they are handed out, so groupings by these keys and more move no row.
        """
        if until:
            rows = rows.where(F.col(until) >= self.opens)
        groups = _merged(rows, list(keys), measures)
        return each(groups) if each else groups

    def grouped_where_many(self, rows: DataFrame, keys: Sequence[str], measures: Measures, group: Sequence[str], least: int) -> DataFrame:
        """As ``grouped``, and may leave out a ``group`` (some of the keys) with fewer than ``least`` rows, if that spares work; here it spares none."""
        return self.grouped(rows, keys, measures)

    def without_excepted(self, rows: DataFrame, ssl: DataFrame, entries: DataFrame, before: int = HOUR) -> DataFrame:
        """Connections minus those whose server name in the window, or ``before`` seconds ahead of it, an entry covers."""
        return without_excepted_connections(rows, self.rows(ssl, before), entries)


@dataclass(frozen=True)
class HourlyWindows:
    """``[end - hours, end)`` for every full hour ``end`` from ``first`` to ``last``, both included."""

    first: datetime
    last: datetime
    hours: int = 24
    keys: tuple[str, ...] = ("window_end",)

    def __post_init__(self):
        for name in ("first", "last"):
            value = utc_datetime(getattr(self, name))
            if value.minute or value.second or value.microsecond:
                raise ValueError(f"{name} must be a full hour")
            object.__setattr__(self, name, value)

    @property
    def opens(self) -> Column:
        """Where the first window begins."""
        return instant(self.first - timedelta(hours=self.hours))

    @property
    def bounds(self) -> tuple[int, int]:
        return tuple(int((v - datetime(1970, 1, 1)) / timedelta(hours=1)) for v in (self.first, self.last))

    def rows(self, df: DataFrame, before: float = 0.0, ts: str = "ts") -> DataFrame:
        """The rows of all windows and of ``before`` seconds ahead of the first."""
        return time_slice(df, self.first - timedelta(hours=self.hours, seconds=before), self.last, ts)

    def ends_of(self, first_pane: str | Column, last_pane: str | Column, reach: int = 0) -> Column:
        """Array of the window ends (hour numbers) that hold both panes, with ``reach`` hours ahead of a window as part of it."""
        first, last = self.bounds
        earlier, later = (F.col(c) if isinstance(c, str) else c for c in (first_pane, last_pane))
        low, high = F.greatest(later + 1, F.lit(first)), F.least(earlier + self.hours + reach, F.lit(last))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    def spread(self, panes: DataFrame, ends: Column) -> DataFrame:
        """A pane for each of its window ends, but for those it was left out of."""
        if "left_out" in panes.columns:
            ends = F.array_except(ends, F.coalesce("left_out", F.array().cast("array<bigint>")))
        return panes.withColumn("end_no", F.explode(ends)).withColumn("window_end", F.timestamp_seconds(F.col("end_no") * HOUR))

    def grouped(
        self, rows: DataFrame, keys: Sequence[str], measures: Measures, until: str | None = None, before: int = 0, ts: str = "ts", each: Step | None = None,
        together: Sequence[str] = (),
    ) -> DataFrame:
        panes = rows.withColumn("pane", hour_of(ts))
        extra = ["pane", *(["left_out"] if "left_out" in rows.columns else [])]
        if until:
            panes, extra = panes.withColumn("last_pane", hour_of(until)), [*extra, "last_pane"]
        states = _merged(panes, [*keys, *extra], measures)
        states = each(states) if each else states
        added = [c for c in states.columns if c not in {*keys, *extra, *measures}]
        if together:
            # As many partitions as any shuffle has: few small panes become many rows, so their own size must not decide.
            states = states.repartition(int(states.sparkSession.conf.get("spark.sql.shuffle.partitions")), *together)
        ends = self.ends_of("pane", "pane", before // HOUR)
        if until:  # the row ends before the window opens in all later windows
            ends = F.filter(ends, lambda e: e <= F.col("last_pane") + self.hours)
        spread = self.spread(states, ends)
        return _merged(spread, ["window_end", *keys, *added], {name: (kind, F.col(name)) for name, (kind, _) in measures.items()})

    def grouped_where_many(self, rows: DataFrame, keys: Sequence[str], measures: Measures, group: Sequence[str], least: int, ts: str = "ts") -> DataFrame:
        """As ``grouped``, but panes are handed out only of groups that can reach ``least`` rows in some window.

        A window lies in two neighbouring eras of its own length. A group's row in a window is a combination of the other keys, so a group
        with fewer combinations in two such eras reaches ``least`` in none of the windows that begin in the first.
        """
        panes = rows.withColumn("pane", hour_of(ts))
        states = _merged(panes, [*keys, "pane"], measures).withColumn("era", F.floor(F.col("pane") / self.hours))
        own = panes.select(*keys, F.floor(F.col("pane") / self.hours).alias("era")).distinct().groupBy(*group, "era").agg(F.count("*").alias("kinds"))
        pairs = own.withColumn("first", F.explode(F.array(F.col("era") - 1, F.col("era")))).groupBy(*group, "first").agg(F.sum("kinds").alias("kinds")).where(F.col("kinds") >= least)
        busy = pairs.select(*group, F.explode(F.array(F.col("first"), F.col("first") + 1)).alias("era")).distinct()
        states = states.join(busy, [*group, "era"], "left_semi")
        return _merged(self.spread(states, self.ends_of("pane", "pane")), ["window_end", *keys], {name: (kind, F.col(name)) for name, (kind, _) in measures.items()})

    def counted_where_many(self, rows: DataFrame, keys: Sequence[str], measures: Measures, group: Sequence[str], least: int, ts: str = "ts") -> DataFrame:
        """The measures of a ``group`` (some of the keys) in each window, and ``kinds``, its combinations of the other keys there, where these are at least ``least``.

        Rows move once, to their group and block of time, which has the rows of its first windows, too. There a group is a line of hours at
        which something enters or leaves the window, with running values; between two of them all windows are equal, and only lines that
        reach ``least`` are unrolled into windows. A combination enters once for all its panes that follow each other within a window.
        Groups with a null among their keys are left out.
        """
        length, block, others = self.hours * SPAN, [*group, "block"], [k for k in keys if k not in group]
        blocks = F.sequence(F.floor(hour_of(ts) / length), F.floor((hour_of(ts) + self.hours - 1) / length))
        rows = rows.dropna(subset=list(group)).withColumn("block", F.explode(blocks))
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *block).withColumn("pane", hour_of(ts))
        run, line = Window.partitionBy(*block, *others).orderBy("pane"), Window.partitionBy(*block).orderBy("at")
        panes = _merged(rows, [*keys, "block", "pane"], measures).withColumns({"last_pane": F.lag("pane").over(run), "next_pane": F.lead("pane").over(run)})
        panes = panes.withColumn("enters", F.when(F.col("pane") - F.col("last_pane") <= self.hours, 0).otherwise(1))
        panes = panes.withColumn("most", F.sum("enters").over(Window.partitionBy(*block))).where(F.col("most") >= least)
        leaves = F.when(F.col("next_pane") - F.col("pane") <= self.hours, 0).otherwise(-1)
        steps = panes.withColumn("leaves", leaves).withColumn("old", F.explode(F.array(F.lit(False), F.lit(True))))
        steps = steps.withColumn("at", F.col("pane") + F.when(F.col("old"), self.hours).otherwise(0)).groupBy(*block, "at").agg(
            F.sum(F.when(F.col("old"), F.col("leaves")).otherwise(F.col("enters"))).alias("change"),
            *[MERGE[kind](F.when(~F.col("old"), F.col(name))).alias(name) for name, (kind, _) in measures.items()],
        )
        inside = line.rangeBetween(1 - self.hours, 0)
        found = steps.withColumns({
            "kinds": F.sum("change").over(line.rowsBetween(Window.unboundedPreceding, 0)), "until": F.lead("at").over(line),
            **{name: MERGE[kind](F.col(name)).over(inside) for name, (kind, _) in measures.items()},
        }).where(F.col("kinds") >= max(least, 1))
        first, last = self.bounds
        low, high = F.greatest(F.col("at") + 1, F.col("block") * length + 1, F.lit(first)), F.least("until", (F.col("block") + 1) * length, F.lit(last))
        ends = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return found.withColumn("end_no", F.explode(ends)).select(F.timestamp_seconds(F.col("end_no") * HOUR).alias("window_end"), *group, "kinds", *measures)

    def without_excepted(self, rows: DataFrame, ssl: DataFrame, entries: DataFrame, before: int = HOUR) -> DataFrame:
        """Adds ``left_out``: the window ends in which an entry covers the connection's server name (the smallest that the window saw).

        Only connections that logged a covered name at some time are looked at window by window.
        """
        named = self.rows(ssl, before).where(F.col("server_name") != "").select("uid", "server_name", hour_of("ts").alias("pane"))
        covered = excepted_names(named, "server_name", entries)
        touched = named.join(covered, named["server_name"] == covered["name"], "left_semi").select("uid").distinct()
        ends = self.ends_of("pane", "pane", before // HOUR)
        seen = named.join(touched, "uid", "left_semi").select("uid", "server_name", F.explode(ends).alias("end_no"))
        smallest = seen.groupBy("uid", "end_no").agg(F.min("server_name").alias("server_name"))
        out = smallest.join(covered, smallest["server_name"] == covered["name"], "left_semi").groupBy("uid").agg(F.array_sort(F.collect_set("end_no")).alias("left_out"))
        return rows.join(out, "uid", "left")

    def trailing_sums(self, panes: DataFrame, keys: Sequence[str], value: str, asked: DataFrame, hours: int, back: int = 0) -> DataFrame:
        """For each asked (keys, end_no) the sum of ``value`` over the ``hours`` panes that end ``back`` hours before the window's end.

        Panes and questions go through one sort per group, which holds at most a row for each hour and kind.
        """
        empty = F.lit(None).cast("long")
        line = panes.select(*keys, F.col("pane").alias("at"), F.col(value).alias("amount"), empty.alias("end_no"))
        line = line.unionByName(asked.select(*keys, "end_no").distinct().select(*keys, (F.col("end_no") - 1 - back).alias("at"), F.lit(0).cast("long").alias("amount"), "end_no"))
        total = F.sum("amount").over(Window.partitionBy(*keys).orderBy("at").rangeBetween(1 - hours, 0))
        return line.withColumn("total", total).where(F.col("end_no").isNotNull()).select(*keys, "end_no", "total")


def _merged(rows: DataFrame, keys: list[str], measures: Measures) -> DataFrame:
    if not measures:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*[MERGE[kind](column).alias(name) for name, (kind, column) in measures.items()])
