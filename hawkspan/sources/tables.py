"""Tables on shared storage: daily partitions, appends, closing of days, whole-table replacement and retention.

An event table is a folder per day, in it a folder per batch, named after the writer and the batch's number, and in that, for
connections, a folder per length class. Streams leave many small folders; ``close_day`` rewrites a day sorted into few files and notes in the table's manifest
which batches these stand for. Readers take the manifest first and list files then, and the manifest decides which folders count: they
see the old files or the new ones, never both and never neither. ``sweep`` removes what no reader of the present needs any more.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkspan import schemas
from hawkspan.functions.times import instant, plus_seconds, utc_datetime

# Leading columns each table is sorted by inside its files, so that row groups can be skipped.
SORT_COLUMNS = {
    "conn": ["id_orig_h", "id_resp_h", "id_resp_p", "ts"], "dns": ["query", "id_orig_h", "ts"], "http": ["host", "id_orig_h", "ts"],
    "ssl": ["server_name", "id_orig_h", "ts"], "x509": ["fingerprint", "ts"], "notice": ["note", "ts"], "alert": ["alert_signature_id", "src_ip", "timestamp"],
    "stats": ["timestamp"], "cowrie": ["eventid", "src_ip", "timestamp"], "metrics": ["name", "timestamp"],
}
# Columns by which single rows are looked up: their files get Bloom filters.
LOOKUP_COLUMNS = {"conn": ["community_id", "uid"], "alert": ["community_id"], "dns": ["uid"], "http": ["uid"], "ssl": ["uid"], "cowrie": ["session"]}
DISTINCT_IN_ROW_GROUP = 1_000_000  # what the Bloom filters are sized for
CLOSED = "c"  # the writer of closed days
MANIFEST = "date string, generation bigint, writer string, upto bigint, committed_at string"
HOUR = 3600


def length_class(duration: Column) -> Column:
    """0 below an hour, n for ``2 ** (n - 1)`` up to ``2 ** n`` hours: what began in an earlier hour is found by the classes that reach so far."""
    hours = duration / HOUR
    return F.when(hours >= 1, F.floor(F.log2(hours)) + 1).otherwise(0).cast("int")


#: Partition columns below day and batch, from the rows of a table.
FILED = {"conn": {"span": lambda: length_class(F.col("duration"))}}


class TableStore:
    """Event tables below one root, one folder per table, partitioned by ``date`` and batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # --- event tables ------------------------------------------------------------------------------------------------

    def write_batch(self, table: str, rows: DataFrame, writer: str, number: int) -> None:
        """Write one batch to folders named after it: a batch repeated after a failure overwrites itself, so rows count once."""
        filed = rows.withColumns({"date": F.to_date(schemas.event_time(table)), "batch": F.lit(f"{writer}-{number}"), **{c: make() for c, make in FILED.get(table, {}).items()}})
        write = self._formatted(table, filed).partitionBy("date", "batch", *FILED.get(table, {}))
        write.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path(table))

    def append_events(self, table: str, rows: DataFrame) -> None:
        """Append rows by event day, as a batch of a writer of its own. Rows of one day are written by several tasks, so a busy day or
        key does not end up in one file writer."""
        self.write_batch(table, rows, f"w{uuid.uuid4().hex[:12]}", 0)

    def _formatted(self, table: str, rows: DataFrame):
        writer = rows.write.option("compression", "zstd")
        for column in LOOKUP_COLUMNS.get(table, ()):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(DISTINCT_IN_ROW_GROUP))
        return writer

    def events(self, table: str, ddl: str | None = None) -> DataFrame:
        """The table with its partition columns; time slices prune on ``date``."""
        latest = self._latest(table)  # before the files are listed: a day that is closed in between is read from its old files
        reader = self.spark.read
        if ddl:
            reader = reader.schema(f"{ddl}, date date, batch string" + "".join(f", {c} int" for c in FILED.get(table, {})))
        return reader.parquet(self.path(table)).where(_counts(latest))

    def _latest(self, table: str) -> dict[str, dict]:
        """What the manifest says by day: the generation that counts, and per writer the last batch it stands for. A row per day and writer."""
        if not self.exists(f"{table}/_manifest"):
            return {}
        entries = self.spark.read.schema(MANIFEST).json(f"{self.path(table)}/_manifest")
        newest = entries.groupBy("date").agg(F.max("generation").alias("generation"))
        days: dict[str, dict] = {}
        for r in entries.join(newest, ["date", "generation"]).collect():
            day = days.setdefault(r["date"], {"generation": r["generation"], "committed_at": r["committed_at"], "upto": {}})
            day["upto"][r["writer"]] = r["upto"]
        return days

    def close_day(self, table: str, day: str, file_bytes: int = 128 << 20) -> bool:
        """Rewrite a day sorted into files of about ``file_bytes``; False if there is nothing to do. Rows that come later are read beside them."""
        generation = time.time_ns() // 1000
        known = self._latest(table).get(day, {"upto": {}})
        rows = self.events(table).where(F.col("date") == F.lit(day).cast("date"))
        # As many names as the day has batches.
        batches = [r["batch"].rsplit("-", 1) for r in rows.select("batch").distinct().collect()]
        if not batches or (len(batches) == 1 and batches[0][0] == CLOSED):
            return False
        files = max(1, -(-self._bytes(f"{table}/date={day}") // file_bytes))
        ordered = rows.drop("date", "batch").repartitionByRange(files, *SORT_COLUMNS[table]).sortWithinPartitions(*FILED.get(table, {}), *SORT_COLUMNS[table])
        self._formatted(table, ordered).partitionBy(*FILED.get(table, {})).parquet(f"{self.path(table)}/date={day}/batch={CLOSED}-{generation}")
        upto = dict(known["upto"])
        for writer, number in batches:
            if writer != CLOSED:
                upto[writer] = max(upto.get(writer, -1), int(number))
        now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")
        entries = [(day, generation, writer, number, now) for writer, number in sorted(upto.items())]
        # One file, which appears as a whole: from then on the new files count and the old ones do not.
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path(table)}/_manifest")
        return True

    def sweep(self, table: str, committed_before: datetime) -> list[str]:
        """Remove batch folders that no longer count, of days closed before an instant that no running reader began ahead of."""
        limit, dropped = utc_datetime(committed_before).strftime("%Y-%m-%d %H:%M:%S.%f"), []
        for day, said in sorted(self._latest(table).items()):
            if said["committed_at"] >= limit:
                continue
            for folder in self._folders(f"{table}/date={day}", "batch=*"):
                writer, number = folder.getName().removeprefix("batch=").rsplit("-", 1)
                stale = int(number) < said["generation"] if writer == CLOSED else int(number) <= said["upto"].get(writer, -1)
                if stale:
                    self._files(folder).delete(folder, True)
                    dropped.append(f"{day}/{folder.getName()}")
        return sorted(dropped)

    def find(self, table: str, column: str, values: Sequence[str], ddl: str | None = None) -> DataFrame:
        """Rows with one of a few values in a look-up column; files' Bloom filters keep the other row groups closed."""
        if column not in LOOKUP_COLUMNS.get(table, ()):
            raise ValueError(f"{table} is not looked up by {column}")
        return self.events(table, ddl).where(F.col(column).isin(*values))

    # --- other tables ------------------------------------------------------------------------------------------------

    def append_rows(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(table))

    def rows(self, table: str, ddl: str | None = None) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(self.path(table)) if ddl else self.spark.read.parquet(self.path(table))

    # A replaced table is a set of version folders and a growing list of pointer files. The new version is written in full
    # before its pointer is added, and no pointer is ever deleted, so readers see the old table or the new one.

    def replace(self, table: str, rows: DataFrame) -> str:
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.path(table)}/v-{version}")
        pointer = self._pointers(table).agg(F.coalesce(F.max("number"), F.lit(0)).alias("number")) if self.exists(f"{table}/current") else self.spark.range(1).select(F.lit(0).alias("number"))
        pointer.select((F.col("number") + 1).cast("long").alias("number"), F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{self.path(table)}/current")
        return version

    def _pointers(self, table: str) -> DataFrame:
        return self.spark.read.schema("number long, version string").json(f"{self.path(table)}/current")

    def current(self, table: str) -> DataFrame:
        newest = self._pointers(table).agg(F.max(F.struct("number", "version")).alias("newest")).head()["newest"]
        if newest is None:
            raise FileNotFoundError(f"no current version of {table}")
        return self.spark.read.parquet(f"{self.path(table)}/v-{newest['version']}")

    # --- files -------------------------------------------------------------------------------------------------------

    def _folder(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def _files(self, folder):
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _folders(self, name: str, pattern: str) -> list:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/{pattern}")
        return [status.getPath() for status in self._files(folder).globStatus(folder) or []]

    def _bytes(self, name: str) -> int:
        folder = self._folder(name)
        return self._files(folder).getContentSummary(folder).getLength()

    def exists(self, table: str) -> bool:
        folder = self._folder(table)
        return self._files(folder).exists(folder)

    def expire(self, table: str, as_of, days: int | None = None) -> list[str]:
        """Drop whole days past the retention period; returns the dropped partition names (at most one per day kept)."""
        days = schemas.RETENTION_DAYS[table] if days is None else days
        limit = self.spark.range(1).select(F.to_date(plus_seconds(instant(as_of), -days * 86400.0)).cast("string").alias("d")).head()["d"]
        dropped = []
        for folder in self._folders(table, "date=*"):
            if folder.getName()[5:] < limit:
                self._files(folder).delete(folder, True)
                dropped.append(folder.getName())
        return sorted(dropped)


def _counts(latest: dict[str, dict]) -> Column:
    """Whether a batch's folder counts. A condition on partition columns only, so other folders are not opened."""
    if not latest:
        return ~F.col("batch").startswith(f"{CLOSED}-")
    day, writer, number = F.col("date").cast("string"), F.substring_index("batch", "-", 1), F.substring_index("batch", "-", -1).cast("long")
    live = F.create_map(*[F.lit(x) for date, said in latest.items() for x in (date, said["generation"])])
    upto = F.create_map(*[F.lit(x) for date, said in latest.items() for name, last in said["upto"].items() for x in (f"{date}|{name}", last)])
    closed = F.coalesce(number == F.try_element_at(live, day), F.lit(False))
    open_ = F.coalesce(number > F.try_element_at(upto, F.concat_ws("|", day, writer)), F.lit(True))
    return F.when(writer == CLOSED, closed).otherwise(open_)


def retain(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows whose day is still kept; days go as a whole."""
    limit = F.to_date(plus_seconds(instant(as_of), -days * 86400.0))
    return df.where(F.col("date") >= limit) if "date" in df.columns else df.where(F.to_date(ts) >= limit)


def write_result(df: DataFrame, path: str, form: str = "json") -> None:
    """Query results as JSON lines or tab-separated text."""
    if form == "json":
        df.write.json(path)
    elif form == "tsv":
        flat = [F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in df.dtypes]
        df.select(*flat).write.option("sep", "\t").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {form}")
