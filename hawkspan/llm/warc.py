"""WARC archives: writing, reading, reassembling segmented records, and undoing chunked transfer framing.

A page becomes an HTTP response whose body is sent in chunks. Blocks above a size are split: the first segment keeps the record's type,
the others are ``continuation`` records that name the origin and their number, and the last one states the total length. Pages whose
payload was written before become ``revisit`` records. Reading parses records file by file; segments, which may lie in any file, are
grouped by origin identifier in Spark, put in order of their number and verified: numbers 1 to n without gap or repetition, and the
stated total length. Archives are gzip members, one a record, in a folder that all executors reach; they are moved into place when whole.

Defined cases: a null payload counts as empty; of equal payloads the smallest identifier (of equal ones, the first place in the
files) is the response; null identifiers come last; an incomplete or badly framed record reads as status ``incomplete`` or
``malformed`` with a null payload; an empty table gives no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkspan.llm.base import register, table, work_dir
from hawkspan.llm.token_files import open_folder
from hawkspan.session import stored

SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 4_000, 8_192, 1_000_000_000
RECORD = "record_id string, type string, page_id bigint, target string, number int, origin string, total bigint, refers_to string, digest string, block binary"
PAGE = "record_id string, page_id bigint, type string, refers_to string, status string, payload_bytes bigint, payload_digest string, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; chunk extensions and trailers are allowed, anything else raises ValueError."""
    parts, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size_text = framed[at:end].partition(b";")[0].strip()
        if not size_text or size_text.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("no chunk size")
        size = int(size_text, 16)
        at = end + 2
        if size == 0:
            if not framed[at:].endswith(b"\r\n"):
                raise ValueError("no end of trailers")
            return b"".join(parts)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk does not end where it should")
        parts.append(framed[at : at + size])
        at += size + 2


def http_body(block: bytes) -> bytes:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of HTTP headers")
    names = dict(_header(line) for line in head.split(b"\r\n")[1:])
    return unchunked(body) if "chunked" in names.get("transfer-encoding", "").lower() else body


def _header(line: bytes) -> tuple[str, str]:
    name, _, value = line.decode("utf-8", "replace").partition(":")
    return name.strip().lower(), value.strip()


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_records(record_id: str, page_id: int | None, url: str, payload: bytes, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The record of a page, or its segments."""
    common = {"WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": "".join(url.split()) or "about:blank", "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}"}
    if page_id is not None:
        common["WARC-Page-ID"] = str(page_id)
    kind = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{record_id}>", "Content-Type": "application/http; msgtype=response"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        yield record_bytes(kind | common | {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, head)
        return
    block = head + chunked(payload)
    if len(block) <= segment_bytes:
        yield record_bytes(kind | common, block)
        return
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record_bytes(kind | common | {"WARC-Segment-Number": "1"}, pieces[0])
    for number, piece in enumerate(pieces[1:], 2):
        last = {"WARC-Segment-Total-Length": str(len(block))} if number == len(pieces) else {}
        yield record_bytes({"WARC-Type": "continuation", "WARC-Record-ID": f"<{record_id}:{number}>", "WARC-Date": common["WARC-Date"], "WARC-Target-URI": common["WARC-Target-URI"], "WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Number": str(number)} | last, piece)


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, payload: str = "html", identifier: str = "page_id", url: str = "url") -> DataFrame:
    """Write every page and return the manifest (path, records). ``pages`` must be read from files: a row's place names its record."""
    meta = pages.metadataColumn("_metadata")
    rows = pages.select(
        pages[identifier].cast("bigint").alias("page_id"), F.coalesce(pages[url], F.lit("")).alias("url"), F.coalesce(pages[payload], F.lit("")).alias("payload"),
        F.concat_ws(":", F.lit("urn:page"), pages[identifier].cast("string"), F.hex(F.xxhash64(meta["file_path"])), meta["row_index"]).alias("record_id"),
    ).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    first = rows.groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id")).alias("first"))
    told = rows.join(first, "sha").select("page_id", "url", "payload", "record_id", F.when(F.col("record_id") != F.col("first.record_id"), F.col("first.record_id")).alias("refers_to"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = open_folder(folder)
        files.create_dir(where, recursive=True)
        out, name, size, count, done = None, "", 0, 0, []

        def close():
            out.close()
            path = f"{where}/part-{uuid.uuid4().hex}.warc.gz"
            files.move(name, path)
            done.append((f"{folder}/{os.path.basename(path)}", count))

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for row in batch.slice(at, 500).to_pylist():
                    if out is None:
                        name, size, count = f"{where}/.{uuid.uuid4().hex}", 0, 0
                        out = files.open_output_stream(name)
                    for record in page_records(row["record_id"], row["page_id"], row["url"], row["payload"].encode(), row["refers_to"], segment_bytes):
                        packed = zlib.compress(record, 4, 31)
                        out.write(packed)
                        size, count = size + len(packed), count + 1
                    if size > ARCHIVE_BYTES:
                        close()
                        out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": pa.array([d[1] for d in done], pa.int64())})

    return stored(told.mapInArrow(write, "path string, records bigint"), "warc-manifest")


def parse_members(read) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a stream of gzip members; ``read(n)`` gives bytes. Memory holds one record at a time."""
    unpack, raw, data = zlib.decompressobj(31), b"", bytearray()
    while True:
        raw = raw or read(1 << 20)
        if raw:
            data += unpack.decompress(raw)
            raw = unpack.unused_data
            if not unpack.eof:
                continue
            unpack = zlib.decompressobj(31)
        at = 0
        while (end := data.find(b"\r\n\r\n", at)) >= 0:
            lines = bytes(data[at:end]).split(b"\r\n")
            headers = dict(_header(line) for line in lines[1:])
            stop = end + 4 + int(headers["content-length"])
            if len(data) < stop + 4:
                break
            yield headers, bytes(data[end + 4 : stop])
            at = stop + 4
        del data[:at]
        if not raw and not (raw := read(1 << 20)):
            if data:
                raise ValueError("the archive ends inside a record")
            return


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives, segments apart."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def number(headers, name):
            return int(headers[name]) if name in headers else None

        for batch in batches:
            for path in batch["path"].to_pylist():
                files, where = open_folder(path)
                rows, size = [], 0
                with files.open_input_stream(where, compression=None) as stream:
                    for h, block in parse_members(stream.read):
                        rows.append((
                            h["warc-record-id"].strip("<>"), h["warc-type"], number(h, "warc-page-id"), h.get("warc-target-uri"), number(h, "warc-segment-number"),
                            h.get("warc-segment-origin-id", "").strip("<>") or None, number(h, "warc-segment-total-length"), h.get("warc-refers-to", "").strip("<>") or None,
                            h.get("warc-payload-digest", "").removeprefix("sha1:") or None, block,
                        ))
                        size += len(block)
                        if size > 8_000_000 or len(rows) >= 2000:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(read, RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """Records with their blocks in order: record_id, type, page_id, target, refers_to, digest, whole, blocks. A record's segments are one row's worth of data."""
    one = records.where("number IS NULL").select("record_id", "type", "page_id", "target", "refers_to", "digest", F.lit(True).alias("whole"), F.array("block").alias("blocks"))
    segments = records.where("number IS NOT NULL").withColumn("origin", F.coalesce("origin", "record_id"))
    grouped = segments.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("type", "page_id", "target", "refers_to", "digest")],
    )
    length = F.aggregate("parts", F.lit(0).cast("bigint"), lambda sum_, p: sum_ + F.octet_length(p["block"]))
    numbers = F.transform("parts", lambda p: p["number"])
    whole = (numbers == F.sequence(F.lit(1), F.size("parts"))) & F.col("total").isNotNull() & (length == F.col("total"))
    return one.unionByName(grouped.select(F.col("origin").alias("record_id"), F.coalesce("type", F.lit("continuation")).alias("type"), "page_id", "target", "refers_to", "digest", whole.alias("whole"), F.transform("parts", lambda p: p["block"]).alias("blocks")))


def payloads(records: DataFrame, content: bool = True) -> DataFrame:
    """record_id, page_id, type, refers_to, status, payload_bytes, payload_digest and (with ``content``) payload of whole records, and
    ``refers_to_page``, the page identifier in the record that a revisit refers to.

    Status: ``ok``; ``incomplete``; ``malformed``; ``digest`` if the payload differs from the digest in the record. A revisit has its
    digest from the record and its length from the record it refers to (``missing`` if there is none, ``digest`` if the digests differ).
    """

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for r in batch.slice(at, 500).to_pylist():
                    status, payload, digest = "ok", None, r["digest"]
                    if not r["whole"]:
                        status = "incomplete"
                    elif r["type"] == "response":
                        try:
                            payload = http_body(b"".join(r["blocks"]))
                            digest = payload_digest(payload)
                            status = "ok" if r["digest"] in (None, digest) else "digest"
                        except ValueError:
                            status = "malformed"
                    rows.append((r["record_id"], r["page_id"], r["type"], r["refers_to"], status, None if payload is None else len(payload), digest, payload if content else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in PAGE.split(", ")])

    decoded = stored(reassembled(records).mapInArrow(decode, PAGE), "warc-payloads")
    origin = decoded.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("origin_bytes"), F.col("payload_digest").alias("origin_digest"), F.col("page_id").alias("refers_to_page"), F.lit(True).alias("known"))
    revisits = decoded.where("type = 'revisit' AND refers_to IS NOT NULL").join(origin, "refers_to", "left")
    status = F.when(F.col("known").isNull(), "missing").when(F.col("origin_digest") != F.col("payload_digest"), "digest").otherwise(F.col("status"))
    told = revisits.select("record_id", "page_id", "type", "refers_to", status.alias("status"), F.col("origin_bytes").alias("payload_bytes"), "payload_digest", "payload", "refers_to_page")
    rest = decoded.where("type <> 'revisit' OR refers_to IS NULL").withColumn("refers_to_page", F.lit(None).cast("bigint"))
    return rest.unionByName(told)


@register("op5_warc")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), work_dir(spark, "warc"))
    found = payloads(read_archives(manifest), content=False)
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))
