"""Triggers, bucket counts and notifications as streaming aggregations over event time, and the repair of what came late.

A trigger looks at a trailing window every minute. Rows are counted per source and minute first, and the minutes' counts are summed over
the windows that hold them: two chained aggregations, so the state has a row per source and minute however many rows and windows there
are. Results are appended when their window is complete. Rows behind the watermark cannot change those any more; they are set aside with
a count, and ``repaired`` judges the windows again that they touch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hawkspan import schemas
from hawkspan.functions.text import registered_domain
from hawkspan.plans.common import PRODUCTION_IFACE
from hawkspan.plans.response import EVALUATION, HANDS_ON_EVENTS, JITTER, _severe, action_rows, block_totals, decide, evidence, ip_history, sliding
from hawkspan.sources.tables import TableStore

LATE = "2 hours"


def _closed_at_end(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Adds ``at``, a microsecond before the event, under a watermark: windows ``[start, end)`` of it are ``(start, end]`` of
    the event time, as in the batch form, so an event on a full minute counts from that minute's evaluation on."""
    return rows.withColumn("at", F.timestamp_micros(F.unix_micros(ts) - 1)).withWatermark("at", late)


def _by_minute(rows: DataFrame, length: str, **counts: Column) -> DataFrame:
    """Sums of per-minute counts (columns of 0 and 1) over every trailing window: evaluated_at, src_ip and the sums."""
    minutes = rows.groupBy(F.window("at", "1 minute"), "src_ip").agg(*[F.sum(c).alias(name) for name, c in counts.items()])
    sums = minutes.groupBy(F.window(F.window_time("window"), length, "1 minute"), "src_ip").agg(*[F.sum(name).alias(name) for name in counts])
    return sums.select(F.col("window.end").alias("evaluated_at"), "src_ip", *counts)


def _one(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def honeypot_attackers_stream(cowrie: DataFrame, late: str = LATE) -> DataFrame:
    """Sources over the limits per 15-minute window, moved every minute."""
    event = F.col("eventid")
    rows = _closed_at_end(cowrie, "timestamp", late).where(F.col("src_ip") != "")
    counts = _by_minute(
        rows, "15 minutes", entered=_one(event == "cowrie.login.success"), used=_one(event.isin(*HANDS_ON_EVENTS)), refused=_one(event == "cowrie.login.failed"),
    )
    hit = ((F.col("entered") >= 1) & (F.col("used") >= 1)) | (F.col("refused") >= 20)
    return counts.where(hit).select("evaluated_at", "src_ip")


def severe_alerts_stream(alerts: DataFrame, iface: str = PRODUCTION_IFACE, late: str = LATE) -> DataFrame:
    return _by_minute(_severe(_closed_at_end(alerts, "timestamp", late), iface), "10 minutes", alerts=F.lit(1))


def ssh_pressure_stream(conn: DataFrame, at_least: int = 30, late: str = LATE) -> DataFrame:
    rows = _closed_at_end(conn, "ts", late).where((F.col("id_resp_p") == 22) & ~F.col("local_orig") & F.col("local_resp"))
    return _by_minute(rows.withColumn("src_ip", F.col("id_orig_h")), "10 minutes", connections=F.lit(1)).where(F.col("connections") >= at_least)


def nxdomain_buckets_stream(dns: DataFrame, minutes: int = 10, late: str = LATE) -> DataFrame:
    """Queries, failures and distinct failed domains per source and bucket, as input of the spike rule.

    The first aggregation has a state row for each failed domain of a source and bucket, the second counts those rows: the number is exact.
    """
    failed = F.col("rcode_name") == "NXDOMAIN"
    rows = dns.withWatermark("ts", late).where(F.col("query") != "").select("ts", F.col("id_orig_h").alias("src"), F.when(failed, registered_domain("query")).alias("domain"))
    domains = rows.groupBy(F.window("ts", f"{minutes} minutes"), "src", "domain").agg(F.count("*").alias("n"))
    known = F.col("domain").isNotNull()
    counts = domains.groupBy(F.window(F.window_time("window"), f"{minutes} minutes"), "src").agg(
        F.sum("n").alias("total"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("nx"), F.sum(_one(known)).alias("nx_domains")
    )
    return counts.select(F.col("window.start").alias("bucket"), "src", "total", "nx", "nx_domains")


# --- notifications ---------------------------------------------------------------------------------------------------

NOTICE = "rule string, src_ip string, notified_at timestamp, episode timestamp"


def notifications_stream(firing: DataFrame, repeat_seconds: int = 1800, late: str = "2 minutes") -> DataFrame:
    """Firing evaluations (rule, src_ip, evaluated_at) thinned as ``response.dedupe_notifications`` does, as they come.

    The state of a rule and source is its running episode; it expires when the watermark passes the next evaluation's time.
    Evaluations behind the newest one of their episode are repetitions and say nothing.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        moments = sorted({int(m.value) for part in parts for m in part["evaluated_at"]})
        last, started, turn = state.get if state.exists else (None, None, 0)
        told = []
        for at in moments:
            if last is not None and at <= last:
                continue
            if last is None or at // 10**9 - last // 10**9 > EVALUATION + JITTER:
                started, turn = at, 0
                told.append((at, started))
            elif (now := int((at // 10**9 - started // 10**9 + JITTER) // repeat_seconds)) > turn:
                turn = now
                told.append((at, started))
            last = at
        if state.hasTimedOut or last is None:
            state.remove()
        else:
            state.update((last, started, turn))
            state.setTimeoutTimestamp(max(last // 10**6 + (EVALUATION + JITTER) * 1000, state.getCurrentWatermarkMs() + 1))
        if told:
            stamps = [pd.to_datetime([t[i] for t in told]) for i in (0, 1)]
            yield pd.DataFrame({"rule": key[0], "src_ip": key[1], "notified_at": stamps[0], "episode": stamps[1]})

    rows = firing.select("rule", "src_ip", "evaluated_at").withWatermark("evaluated_at", late)
    return rows.groupBy("rule", "src_ip").applyInPandasWithState(step, NOTICE, "last bigint, started bigint, turn bigint", "append", GroupStateTimeout.EventTimeTimeout)


# --- late rows -------------------------------------------------------------------------------------------------------

PROGRESS = "newest timestamp, rows bigint, late bigint, batch string"


def late_rows_batch(store: TableStore, table: str, writer: str, late_seconds: float = 7200.0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that sets aside, below ``late``, the rows that a trigger with this watermark may have dropped.

    The newest event so far, this batch included, stands for the watermark. Triggers that read the same files in the same order see at
    most as much before a row, so every row that they drop is among these. Each batch leaves a row of progress with its counts.
    """
    ts = schemas.event_time(table)

    def handle(rows: DataFrame, batch_id: int) -> None:
        name, progress = f"{writer}-{batch_id}", f"late_progress/{table}"
        newest = rows.agg(F.max(ts).alias("newest"))
        if store.exists(progress):
            own, number = F.col("batch").startswith(f"{writer}-"), F.substring_index("batch", "-", -1).cast("long")
            newest = newest.unionByName(store.rows(progress, PROGRESS).where(~own | (number < batch_id)).select("newest"))
        limit = newest.agg((F.max(F.unix_micros("newest")) - int(late_seconds * 1e6)).alias("limit")).head()["limit"]
        behind = F.unix_micros(ts) < F.lit(limit).cast("long")
        _batch_folder(rows.where(behind), name, store.path(f"late/{table}"))
        _batch_folder(rows.agg(F.max(ts).alias("newest"), F.count("*").alias("rows"), F.count_if(behind).alias("late")), name, store.path(progress))

    return handle


def _batch_folder(rows: DataFrame, name: str, path: str) -> None:
    write = rows.withColumn("batch", F.lit(name)).write.option("compression", "zstd")
    write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def repaired(rule: Callable[[dict[str, DataFrame]], DataFrame], table: str, stored: DataFrame, late: DataFrame, source: str, length: str) -> DataFrame:
    """Every evaluation (evaluated_at, src_ip) whose trailing window of ``length`` late rows touch, judged again on all stored rows.

    ``rule`` is the trigger's form over a table by minute. Its columns are null and ``fires`` is false where it does not fire now.
    """
    ts = schemas.event_time(table)
    minute = F.timestamp_seconds(F.ceil(F.unix_micros(ts) / 60e6) * 60)
    moments = late.where(F.col(source) != "").select(F.col(source).alias("src_ip"), minute.alias("minute")).distinct()
    touched = sliding(moments, "minute", length).select("evaluated_at", "src_ip").distinct()
    # Only rows near a late one of the same source are read again: those of its block of a window's length and of the blocks beside it,
    # which hold every window that it touches. What they hold besides makes evaluations that nothing touched, which are left out.
    block = lambda at: F.floor(F.unix_seconds(at) / F.expr(f"unix_seconds(timestamp_seconds(0) + INTERVAL {length})"))
    near = moments.select("src_ip", F.explode(F.array(*[block("minute") + i for i in (-1, 0, 1)])).alias("near")).distinct()
    rows = stored.withColumn("block_", block(minute))
    rows = rows.join(near, (rows[source] == near["src_ip"]) & (rows["block_"] == near["near"]), "left_semi").drop("block_")
    return touched.join(rule({table: rows}).withColumn("fires", F.lit(True)), ["evaluated_at", "src_ip"], "left").withColumn("fires", F.coalesce("fires", F.lit(False)))


# --- decisions -------------------------------------------------------------------------------------------------------


def decision_batch(tables, never_block: DataFrame, actions_path: str, mode: str, as_of_of):
    """A ``foreachBatch`` function: judge a batch of notifications against the log and append the decisions.

    Only this writer appends automatic decisions, which is what keeps the caps right. ``tables`` is called with the batch number for
    fresh views of the events and of the log without that batch's own folder; ``as_of_of`` gives the batch's decision time.
    """

    def handle(rows: DataFrame, batch_id: int) -> None:
        current, as_of = tables(batch_id), as_of_of(batch_id)
        decided = decide(rows, ip_history(current, mode, as_of), block_totals(current, mode, as_of), never_block, as_of, test_net_ok=mode == "test")
        logged = action_rows(decided, evidence(current, as_of), mode, as_of, "responder")
        # One folder per batch: a repeated batch overwrites its own rows and is not counted twice.
        logged.write.mode("overwrite").parquet(f"{actions_path}/batch={batch_id}")

    return handle
