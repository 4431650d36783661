"""Streaming plans over a whole table, run to the end of the input and compared with plain SQL over the same table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acceptance.catalog import Tables, query
from acceptance.detection_queries import domain_sql
from acceptance.state_queries import EVE_AT, NOTICES_SQL, SEVERE, USED, ends, js, lines
from hawkspan.plans import response
from hawkspan.session import discard, settings, work_dir
from hawkspan.sources.tables import TableStore
from hawkspan.streaming import triggers
from hawkspan.streaming.ingest import honeypot_batch

#: A batch's shuffle files go with the batch; the state, a row for each window of a source's minute, is packed.
STREAM_DISK = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.streaming.stateStore.compression.codec": "zstd"}


class Arriving:
    """Tables that arrive one after the other in a folder that streams read, each in as many files as Spark has tasks for it."""

    def __init__(self, t: Tables, *parts: DataFrame):
        self.parts, self.folder = parts, work_dir(t.spark, "arriving")
        parts[0].limit(0).write.parquet(self.folder)  # the folder has to be there before the stream
        self.rows = t.spark.readStream.schema(parts[0].schema).option("recursiveFileLookup", "true").parquet(self.folder)

    def run(self, *starts: Callable[[], StreamingQuery], drop_read: bool = False) -> None:
        """Each part is written whole, then each stream goes on from its checkpoint: a part is a batch, however many files it has.
        With ``drop_read`` its files go when all streams have read it."""
        for i, rows in enumerate(self.parts):
            rows.write.option("compression", "zstd").parquet(part := f"{self.folder}/{i:03d}")
            for start in starts:
                start().awaitTermination()
            if drop_read:
                discard(rows.sparkSession, part)


def signal(rows: DataFrame, ts: str) -> DataFrame:
    """A row far in the future, which closes all windows before it and whose own windows stay open."""
    return rows.orderBy(ts).limit(1).withColumn(ts, F.col(ts) + F.expr("INTERVAL 20000 DAYS"))


def run_to_end(t: Tables, arriving: Arriving, plan: Callable[[DataFrame], DataFrame], *beside: Callable[[], StreamingQuery]) -> DataFrame:
    """Let ``plan`` process everything there is and return what was appended. The streams that ``beside`` starts read each part after it.

    Nothing goes on from the checkpoint after that, so neither it nor what has arrived is kept beside the result.
    """
    out, stream = work_dir(t.spark, "stream"), plan(arriving.rows)

    def keep(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/result/batch={batch_id}")

    writer = stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    with settings(t.spark, STREAM_DISK):
        arriving.run(writer.start, *beside, drop_read=True)
    discard(t.spark, f"{out}/checkpoint")
    return t.spark.read.schema(stream.schema).parquet(f"{out}/result").select(*stream.columns)


def closed(t: Tables, name: str, ts: str, seen: DataFrame) -> Arriving:
    """The derived table as a stream, closed by a signal like a row of ``seen``, the rows that the plan looks at."""
    return Arriving(t, t[name], signal(seen, ts))


query(
    "stream_trigger_honeypot", "evaluated_at t, src_ip s",
    f"""WITH e AS (SELECT {ends('timestamp', 15)} AS evaluated_at, src_ip, eventid FROM cowrie WHERE src_ip <> '') SELECT evaluated_at, src_ip FROM e GROUP BY ALL
    HAVING (count(*) FILTER (WHERE eventid = 'cowrie.login.success') >= 1 AND count(*) FILTER (WHERE {USED}) >= 1) OR count(*) FILTER (WHERE eventid = 'cowrie.login.failed') >= 20""",
)(lambda t: run_to_end(t, closed(t, "cowrie", "timestamp", t["cowrie"].where("src_ip <> ''")), triggers.honeypot_attackers_stream))
query(
    "stream_trigger_severe_alerts", "evaluated_at t, src_ip s, alerts i",
    f"WITH e AS (SELECT {ends('timestamp', 10)} AS evaluated_at, src_ip FROM alert WHERE {SEVERE}) SELECT evaluated_at, src_ip, count(*) AS alerts FROM e GROUP BY ALL",
)(lambda t: run_to_end(t, closed(t, "alert", "timestamp", response._severe(t["alert"], "ens4")), triggers.severe_alerts_stream))
SSH = "id_resp_p = 22 AND NOT local_orig AND local_resp"
SSH_SQL = f"WITH e AS (SELECT {ends('ts', 10)} AS evaluated_at, id_orig_h AS src_ip FROM conn WHERE {SSH}) SELECT evaluated_at, src_ip, count(*) AS connections FROM e GROUP BY ALL"
query("stream_trigger_ssh_pressure", "evaluated_at t, src_ip s, connections i", SSH_SQL)(
    lambda t: run_to_end(t, closed(t, "conn", "ts", t["conn"].where(SSH)), lambda rows: triggers.ssh_pressure_stream(rows, at_least=1))
)
query(
    "stream_nxdomain_buckets", "bucket t, src s, total i, nx i, nx_domains i",
    f"""SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS bucket, id_orig_h AS src, count(*) AS total, count(*) FILTER (WHERE rcode_name = 'NXDOMAIN') AS nx,
    count(DISTINCT CASE WHEN rcode_name = 'NXDOMAIN' THEN {domain_sql('query')} END) AS nx_domains FROM dns WHERE query <> '' GROUP BY ALL""",
)(lambda t: run_to_end(t, closed(t, "dns", "ts", t["dns"].where("query <> ''")), triggers.nxdomain_buckets_stream))


def streamed_notices(t: Tables) -> DataFrame:
    """All evaluations in three batches, in order of time."""
    firing = response.severe_alerts_by_minute(t).select(F.lit("RSP-002").alias("rule"), "src_ip", "evaluated_at")
    day = F.dayofmonth("evaluated_at")
    return run_to_end(t, Arriving(t, firing.where(day < 10), firing.where((day >= 10) & (day < 20)), firing.where(day >= 20)), triggers.notifications_stream)


query("stream_notifications", "rule s, src_ip s, notified_at t", NOTICES_SQL)(streamed_notices)


def repaired_pressure(t: Tables) -> DataFrame:
    """A third of the connections comes when the stream has closed their windows: its results with the repaired ones in their place."""
    on_time, late = F.pmod(F.xxhash64("uid"), F.lit(3)) > 0, F.pmod(F.xxhash64("uid"), F.lit(3)) == 0
    signals = signal(t["conn"].where(SSH), "ts")
    parts = [t["conn"].where(on_time), signals, signals, t["conn"].where(late)]
    arriving, store = Arriving(t, *parts), TableStore(t.spark, work_dir(t.spark, "late"))
    writer = arriving.rows.writeStream.foreachBatch(triggers.late_rows_batch(store, "conn", "w")).option("checkpointLocation", work_dir(t.spark, "late"))
    streamed = run_to_end(t, arriving, lambda rows: triggers.ssh_pressure_stream(rows, at_least=1), writer.trigger(availableNow=True).start)
    late_rows = store.rows("late/conn").where(SSH)
    mended = triggers.repaired(lambda x: response.ssh_pressure_by_minute(x, at_least=1), "conn", t["conn"].where(SSH), late_rows, "id_orig_h", "10 minutes")
    kept = streamed.join(mended, ["evaluated_at", "src_ip"], "left_anti").select("evaluated_at", "src_ip", "connections")
    return kept.unionByName(mended.where("fires").select("evaluated_at", "src_ip", "connections"))


query("stream_repair", "evaluated_at t, src_ip s, connections i", SSH_SQL)(repaired_pressure)


def ingested(t: Tables) -> DataFrame:
    """All honeypot lines in three batches, newest first, and one of them shipped again."""
    store = TableStore(t.spark, work_dir(t.spark, "ingest"))
    batch, part = honeypot_batch(store), F.pmod(F.xxhash64("value"), F.lit(3))
    for batch_id, wanted in enumerate((2, 1, 0, 2)):
        batch(t["raw_cowrie"].where(part == wanted), batch_id)
    return store.events("cowrie")


query(
    "stream_honeypot_ingest", "timestamp t, eventid s, src_ip s, session s, raw s",
    f"SELECT DISTINCT {EVE_AT.format(js('timestamp'))} AS timestamp, {js('eventid')} AS eventid, coalesce({js('src_ip')}, '') AS src_ip, coalesce({js('session')}, '') AS session, value AS raw FROM {lines('raw_cowrie')} WHERE {js('eventid')} LIKE 'cowrie.%'",
)(ingested)
