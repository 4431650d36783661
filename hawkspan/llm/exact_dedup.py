"""Exact deduplication over a stateful stream, in DataFrame operations only.

Arrivals (digest, identifier, locator) are appended to one lasting folder and stream through a keyed aggregation whose state lies on disk
(RocksDB) and never expires. Per digest it retains the stable identifier and the content locator (file and row) of the row that stays,
and how often the digest came. With a ``state_dir`` of the caller's both outlive the call: later arrivals meet what came before. The
files that were given must then stay where they are, for locators lead back into them.

A digest alone proves nothing, so hits are checked on full bytes: of every digest that came more than once the smallest and the largest
text are compared, and where earlier calls had it, the text that a locator of theirs leads to. A digest that holds several texts is
remembered as such, and all its rows, of this call and by locator of earlier ones, are grouped by the text itself.

Defined cases: a null text counts as empty; a null identifier is smaller than any other; of rows with equal text and equal
identifier the one with the greatest locator stays; an empty table gives an empty result; other columns are ignored, whatever their
names. A call returns the rows it was given; what it changes for rows of earlier calls is seen by asking for them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hawkspan.llm.base import register, table, work_dir
from hawkspan.session import stored

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",  # an executor may hold a hundred stores, each with a buffer of its own
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # stores of a stream that has ended are closed this soon, not while later steps run
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk space ahead of need
}
ARRIVAL = "sha binary, doc_id bigint, file string, row bigint, arrived string"
KEEPER = "struct<doc_id:bigint,file:string,row:bigint>"


def located(docs: DataFrame, text: str, identifier: str) -> DataFrame:
    """(content, doc_id, file, row) of a table read from files."""
    meta = docs.metadataColumn("_metadata")
    return docs.select(
        F.coalesce(F.col(text), F.lit("")).alias("content"), F.col(identifier).cast("bigint").alias("doc_id"),
        meta["file_path"].alias("file"), meta["row_index"].alias("row"),
    )


def _digest(bits: int):
    return (F.col("sha") if bits >= 256 else F.substring("sha", 1, max(1, bits // 8))).alias("digest")


def retain(spark: SparkSession, arrivals_dir: str, state_dir: str, digest_bits: int = 256, bytes_per_trigger: int = 10**12) -> DataFrame:
    """Stream the arrivals that the state has not seen yet through it, and return the state: digest, keeper, copies."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    arrivals = spark.readStream.schema(ARRIVAL).option("maxBytesPerTrigger", bytes_per_trigger).parquet(arrivals_dir)
    state = arrivals.withColumn("digest", _digest(digest_bits)).groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keeper"), F.count(F.lit(1)).alias("copies"))
    state.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.format("statestore").load(state_dir)
    keeper, copies = rows.schema["value"].dataType.names
    return rows.select(F.col("key.digest").alias("digest"), F.col(f"value.`{keeper}`").cast(KEEPER).alias("keeper"), F.col(f"value.`{copies}`").alias("copies"))


def followed(spark: SparkSession, locators: DataFrame, text: str) -> DataFrame:
    """The rows of ``locators`` (file, row, ...) with the text they lead to, as ``content``. Only the files that are named are opened."""
    files = [r["file"] for r in locators.select("file").distinct().collect()]  # names of files, of which a table has few for its rows
    if not files:
        return locators.withColumn("content", F.lit(None).cast("string"))
    read = spark.read.parquet(*files)
    meta = read.metadataColumn("_metadata")
    there = read.select(F.coalesce(read[text].cast("string"), F.lit("")).alias("content"), meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    return locators.join(there, ["file", "row"])


def exact_dedup(docs: DataFrame, text: str = "text", identifier: str = "doc_id", state_dir: str | None = None, digest_bits: int = 256, bytes_per_trigger: int = 10**12) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, file, row.

    ``docs`` must be read from files: the locator is the file and the row in it. ``digest_bits`` below 256 makes collisions likely;
    it is there for tests.
    """
    spark = docs.sparkSession
    rows = located(docs, text, identifier)
    folder, call = state_dir or work_dir(spark, "exact-dedup"), uuid.uuid4().hex
    sha = F.unhex(F.sha2("content", 256)).alias("sha")
    rows.select(sha, "doc_id", "file", "row", F.lit(call).alias("arrived")).write.mode("append").parquet(f"{folder}/arrivals")
    arrivals = spark.read.schema(ARRIVAL).parquet(f"{folder}/arrivals").withColumn("digest", _digest(digest_bits))
    state = retain(spark, f"{folder}/arrivals", f"{folder}/state", digest_bits, bytes_per_trigger)
    by_digest = arrivals.where(F.col("arrived") == call).join(state, "digest").drop("arrived")

    # Full bytes of hits. Extremes are taken per task before the shuffle, so a text with a third of all rows travels once per task.
    hits = state.where("copies > 1").select("digest")
    extremes = [F.min("content").alias("low"), F.max("content").alias("high")]
    spread = rows.select("content", sha).select(_digest(digest_bits), "content").groupBy("digest").agg(*extremes).join(hits, "digest", "left_semi")
    mixed = spread.where("low <> high").select("digest")
    earlier = arrivals.where(F.col("arrived") != call)
    again = state_dir is not None and not earlier.isEmpty()
    if again:
        # Of one digest all earlier texts are equal, unless it is remembered as mixed: one of them stands for all.
        one = earlier.join(spread.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max(F.struct("file", "row")).alias("at")).select("digest", "at.*")
        met = followed(spark, one, text).select("digest", "content").join(spread, "digest")
        mixed = mixed.unionByName(met.where("content <> low").select("digest")).unionByName(spark.read.schema("digest binary").parquet(f"{folder}/mixed")).distinct()
    mixed = stored(mixed, "exact-dedup-mixed")
    if state_dir is not None:
        mixed.write.mode("append").parquet(f"{folder}/mixed")
    if not mixed.isEmpty():
        whole = rows.withColumn("sha", sha).withColumn("digest", _digest(digest_bits)).join(mixed, "digest", "left_semi")
        columns = ["content", "doc_id", "file", "row"]
        seen = whole.select(*columns)
        if again:
            before = stored(earlier.join(mixed, "digest", "left_semi").select("doc_id", "file", "row"), "exact-dedup-before")
            seen = seen.unionByName(followed(spark, before, text).select(*columns))
        groups = seen.groupBy("content").agg(F.max(F.struct("doc_id", "file", "row")).alias("keeper"), F.count(F.lit(1)).alias("copies"))
        columns = ["sha", "doc_id", "file", "row", "keeper", "copies"]
        by_digest = by_digest.join(mixed, "digest", "left_anti").select(*columns).unionByName(whole.join(groups, "content").select(*columns))
    return by_digest.select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("copies").alias("group_size"),
        ((F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "file", "row",
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    lost = exact_dedup(docs, **options).where("not kept").select("file", "row")
    meta = docs.metadataColumn("_metadata")
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    return marked.join(lost, ["file", "row"], "left_anti").select("doc.*")


@register(
    "op1_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
