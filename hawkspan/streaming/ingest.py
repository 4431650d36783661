"""Continuous ingest: land immutable files, parse, append by day. One query per log family, each with its own pace, so a
backlog of one does not hold up another. The checkpoint is the memory of what was read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hawkspan import schemas
from hawkspan.operators.ipjoin import geo_enrich
from hawkspan.sources import normalize as n
from hawkspan.sources.tables import TableStore

# Flush interval per family, and the age beyond which files are not read.
PACE = {"alerts": "2 seconds", "sensor": "5 seconds", "honeypot": "5 seconds", "metrics": "10 seconds"}
MAX_FILE_AGE = "48h"
OBJECT_NAME = "*-*.json.gz"


def lines(spark: SparkSession, path: str, max_files: int = 1000, glob: str | None = None) -> DataFrame:
    """Text lines with the path they came from. ``max_files`` bounds a batch, which is the back-pressure."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files).option("maxFileAge", MAX_FILE_AGE).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def _start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, pace: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=pace)).start()


def writer_name(spark: SparkSession, checkpoint: str) -> str:
    """The name under which batches of this checkpoint are stored. A new checkpoint, which counts from 0 again, gets a new name."""
    store = TableStore(spark, checkpoint)
    if not store.exists("writer"):
        spark.createDataFrame([(f"w{uuid.uuid4().hex[:12]}",)], "name string").coalesce(1).write.json(store.path("writer"))
    return spark.read.schema("name string").json(store.path("writer")).head()["name"]


def located(store: TableStore, table: str, rows: DataFrame) -> DataFrame:
    """Rows with country and network of their address, who held it when the event came; empty while the store has no such ranges."""
    if table not in schemas.LOCATED:
        return rows
    ip, prefix = schemas.LOCATED[table]
    ranges = [store.current(name) if store.exists(f"{name}/current") else store.spark.createDataFrame([], ddl) for name, ddl in schemas.GEO_TABLES.items()]
    return geo_enrich(rows, ip, *ranges, prefix)


def _append_batch(store: TableStore, table: str, rows: DataFrame, writer: str, batch_id: int) -> None:
    store.write_batch(table, located(store, table, rows), writer, batch_id)


def _append_rejects(store: TableStore, log: str, parsed: DataFrame, writer: str, batch_id: int) -> None:
    """Unusable lines of a batch with their reason, below ``rejected``."""
    refused = n.rejects(parsed).withColumn("log", F.lit(log)).withColumn("batch", F.lit(f"{writer}-{batch_id}"))
    refused.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log", "batch").parquet(store.path("rejected"))


def append_new(store: TableStore, table: str, rows: DataFrame, keys: list[str], writer: str, batch_id: int) -> None:
    """Append the rows whose keys no other batch has stored, however late they come; of equal rows in the batch one stays.

    Only the stored days that the batch has events of are read, and of them only the keys that the batch has.
    """
    ts = schemas.event_time(table)
    rows = rows.dropDuplicates(keys)
    if store.exists(table):
        days = [r["day"] for r in rows.select(F.to_date(ts).alias("day")).distinct().collect()]  # at most one for each row of the batch
        stored = store.events(table).where((F.col("batch") != f"{writer}-{batch_id}") & F.col("date").isin(*days))
        known = stored.select(*keys).join(rows.select(*keys), keys, "left_semi")
        rows = rows.join(known, keys, "left_anti").select(*rows.columns)
    _append_batch(store, table, rows, writer, batch_id)


def start_sensor_ingest(spark: SparkSession, in_path: str, store: TableStore, checkpoint: str, available_now: bool = False, log_types=tuple(schemas.SENSOR_LOGS)) -> StreamingQuery:
    """Sensor logs, routed to their table by file name; unusable lines go to ``rejected``."""

    writer = writer_name(spark, checkpoint)

    def batch(rows: DataFrame, batch_id: int) -> None:
        routed = rows.withColumn("log", n.log_type_of(F.col("path"))).persist()
        try:
            for log_type in log_types:
                mine = n.parse_sensor_log(routed.where(F.col("log") == log_type), log_type)
                _append_batch(store, log_type, n.normalize_sensor_log(mine.select("value"), log_type), writer, batch_id)
                _append_rejects(store, log_type, mine, writer, batch_id)
        finally:
            routed.unpersist()

    return _start(lines(spark, in_path), batch, checkpoint, PACE["sensor"], available_now)


def start_alert_ingest(spark: SparkSession, in_path: str, store: TableStore, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Alerts and engine counters; a line is parsed once for both and for ``rejected``."""

    writer = writer_name(spark, checkpoint)

    def batch(rows: DataFrame, batch_id: int) -> None:
        parsed = n.parse_engine_events(rows).persist()
        try:
            _append_batch(store, "alert", n.normalize_alerts(parsed).withColumn("loaded_at", F.current_timestamp()), writer, batch_id)
            _append_batch(store, "stats", n.normalize_stats(parsed), writer, batch_id)
            _append_rejects(store, "eve", parsed, writer, batch_id)
        finally:
            parsed.unpersist()

    return _start(lines(spark, in_path), batch, checkpoint, PACE["alerts"], available_now)


def honeypot_batch(store: TableStore, writer: str = "local") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for honeypot lines: every event is stored once, in whatever order objects come."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        parsed = n.parse_honeypot_events(rows).persist()
        try:
            append_new(store, "cowrie", n.normalize_honeypot(parsed), ["session", "eventid", "timestamp", "raw"], writer, batch_id)
            _append_rejects(store, "cowrie", parsed, writer, batch_id)
        finally:
            parsed.unpersist()

    return batch


def start_honeypot_ingest(spark: SparkSession, in_path: str, store: TableStore, checkpoint: str, available_now: bool = False, max_files: int = 1000) -> StreamingQuery:
    """Compressed honeypot objects; an event that several objects hold is kept once."""
    return _start(lines(spark, in_path, max_files, OBJECT_NAME), honeypot_batch(store, writer_name(spark, checkpoint)), checkpoint, PACE["honeypot"], available_now)


def start_metrics_ingest(spark: SparkSession, in_path: str, store: TableStore, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = writer_name(spark, checkpoint)

    def batch(rows: DataFrame, batch_id: int) -> None:
        parsed = n.parse_metrics(rows).persist()
        try:
            _append_batch(store, "metrics", n.normalize_metrics(parsed, F.current_timestamp()), writer, batch_id)
            _append_rejects(store, "metrics", parsed, writer, batch_id)
        finally:
            parsed.unpersist()

    return _start(lines(spark, in_path), batch, checkpoint, PACE["metrics"], available_now)

