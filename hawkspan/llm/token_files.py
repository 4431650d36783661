"""Token ids in binary shards: independent zstandard frames, one a document, with a trailing seek table and checksums.

A shard is a sequence of standard zstandard frames followed by a seek table in a skippable frame, as the public seekable format lays
it out: any zstandard tool can unpack a shard, and a reader finds a document's frame without touching the others. Frame i holds the
ids of the i-th document as little-endian unsigned 32-bit integers. The last frame is the directory: document identifiers (int64)
in order. Every frame's 32-bit checksum (low half of its content's XXH64) lies in the seek table and is verified on reading.

Documents are dealt by ranges of identifiers, so shard after shard gives them in ascending order; a row's place among all ids is
its place in its shard plus the sizes of the shards before. Shards are written under a name of the attempt's own and moved into
place, so a lost or repeated task leaves nothing half-written. They lie in a folder that all executors reach, by any URI that Arrow
opens.

Defined cases: a null text counts as empty (only the end id); a null identifier sorts first and reads back as null; rows that
repeat are written each, ordered by identifier, then text; an empty table gives no shard and no row; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hawkspan.llm.base import register, table, work_dir
from hawkspan.llm.byte_bpe import byte_characters
from hawkspan.llm.chunks import ChunkMemory, kept_in_worker, packed, slices
from hawkspan.session import stored

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
FRAME, FRAME_SIZE, NULL_ID = "<III", 12, -(2**63)
SHARD = "shard int, path string, documents bigint, tokens bigint"
READ = "shard int, place bigint, doc_id bigint, start_in_shard bigint, n_tokens bigint, ids_crc32 bigint"


class ShardWriter:
    """Appends frames to an open binary file."""

    def __init__(self, out, level: int = 3):
        self.out, self.packer, self.table, self.ids = out, zstandard.ZstdCompressor(level=level, write_checksum=False), [], []

    def _frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.out.write(packed)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._frame(ids)
        self.ids.append(NULL_ID if doc_id is None else doc_id)

    def finish(self) -> None:
        self._frame(np.array(self.ids, "<i8").tobytes())
        entries = b"".join(struct.pack(FRAME, *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)


class ShardReader:
    """Reads single documents of a shard; ``file`` is an open random-access file."""

    def __init__(self, file):
        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        size = file.seek(0, 2)
        file.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the shard")
        file.seek(size - 9 - FRAME_SIZE * frames)
        self.table = np.frombuffer(file.read(FRAME_SIZE * frames), "<u4").reshape(frames, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.ids = np.frombuffer(self.frame(frames - 1), "<i8")

    def __len__(self) -> int:
        return len(self.ids)

    def frame(self, i: int) -> bytes:
        self.file.seek(int(self.offsets[i]))
        return self.checked(i, self.file.read(int(self.table[i, 0])))

    def checked(self, i: int, packed: bytes) -> bytes:
        content = self.unpacker.decompress(packed, max_output_size=int(self.table[i, 1])) if self.table[i, 1] else b""
        if len(content) != self.table[i, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} does not match its checksum")
        return content

    def document(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document of that identifier; only their frames are read."""
        first, last = np.searchsorted(self.ids, doc_id, "left"), np.searchsorted(self.ids, doc_id, "right")
        return [np.frombuffer(self.frame(i), "<u4") for i in range(first, last)]


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_shards(docs: DataFrame, folder: str, make_encoder: Callable[[], Callable[[pa.Array], list[bytes]]], end_id: int = 0, shards: int | None = None, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """Encode, append ``end_id``, and write one shard per range of identifiers; the manifest (shard, path, documents, tokens)."""
    spark = docs.sparkSession
    rows = docs.select(docs[identifier].cast("bigint").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = open_folder(folder)
        files.create_dir(where, recursive=True)
        encode, writer, out, shard, tokens, name = make_encoder(), None, None, None, 0, f"{where}/.{uuid.uuid4().hex}"
        for batch in batches:
            for low, high in slices(batch["text"]):
                part = batch.slice(low, high - low)
                if writer is None:
                    shard, out = part["shard"][0].as_py(), files.open_output_stream(name)
                    writer = ShardWriter(out)
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode(part["text"]), strict=True):
                    writer.add(doc_id, ids + end)
                    tokens += len(ids) // 4 + 1
        if writer is not None:
            count = len(writer.ids)
            writer.finish()
            out.close()
            path = f"{where}/shard-{shard:06d}.tok.zst"
            files.move(name, path)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{os.path.basename(path)}"], "documents": pa.array([count], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    return stored(ranged.mapInArrow(write, SHARD), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards in the manifest: doc_id, start, n_tokens, ids_crc32, read back frame by frame."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch["shard"].to_pylist(), batch["path"].to_pylist(), strict=True):
                files, where = open_folder(path)
                with files.open_input_file(where) as raw:
                    reader, start, rows = ShardReader(raw), 0, []
                    raw.seek(0)
                    for i in range(len(reader)):
                        content = reader.checked(i, raw.read(int(reader.table[i, 0])))
                        doc_id = int(reader.ids[i])
                        rows.append((shard, i, None if doc_id == NULL_ID else doc_id, start, len(content) // 4, zlib.crc32(content)))
                        start += len(content) // 4
                        if len(rows) == 5000 or i == len(reader) - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], ["shard", "place", "doc_id", "start_in_shard", "n_tokens", "ids_crc32"])
                            rows = []

    shards = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    documents = manifest.select("shard", "path").repartition(int(shards), "shard").mapInArrow(read, READ)
    # One row a shard: their running sizes are few enough for one task and for a broadcast (a shard holds a task's share of the input).
    before = manifest.select("shard", (F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("before"))
    return documents.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_encoder(vocabulary: str, added_tokens: bool = False) -> Callable[[], Callable[[pa.Array], list[bytes]]]:
    """Makes, once in each Python worker, an encoder by the tokenizers library; the vocabulary's content travels with the task.

    The vocabulary must be byte-level without a normaliser or a prefix space: the library's model then gets pre-tokens as the public
    pattern cuts them, spelled one character a byte. With ``added_tokens`` the result is the library's own: a text that contains an
    added token of the vocabulary is encoded whole by the library. Without, such literals are ordinary text.
    """
    with open(vocabulary, encoding="utf-8") as file:
        content = file.read()
    parts = json.loads(content)
    cutter = parts["pre_tokenizer"] or {}
    if parts["normalizer"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        raise ValueError("the vocabulary must be byte-level, without a normaliser and without a prefix space")
    literals = [token["content"] for token in parts["added_tokens"]] if added_tokens else []

    pattern = "|".join(map(re.escape, literals))

    def make() -> Callable[[pa.Array], list[bytes]]:
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content)
        model = tokenizer.model
        spelling = {b: letter for b, letter in enumerate(byte_characters())}

        def spelled(piece: str) -> str:
            if piece.isascii() and piece.isprintable():  # such letters but the space spell themselves, and a space can only come first
                return f"Ġ{piece[1:]}" if piece[0] == " " else piece
            return piece.encode().decode("latin-1").translate(spelling)

        def encode(pieces: list[str]) -> list[list[int]]:
            return [[x.id for x in model.tokenize(spelled(p))] for p in pieces]

        memory = ChunkMemory(public_tokenizers.PATTERN, encode)

        def encoded(texts: pa.Array) -> list[bytes]:
            apart = pc.match_substring_regex(texts, pattern) if pattern else pa.array([False] * len(texts), pa.bool_())
            rest = iter(memory.encoded_array(texts.filter(pc.invert(apart))))
            whole = iter([packed(tokenizer.encode(text, add_special_tokens=False).ids) for text in texts.filter(apart).to_pylist()])
            return [next(whole) if own else next(rest).tobytes() for own in apart.to_pylist()]

        return encoded

    name = f"tokenizers-{xxhash.xxh3_128_hexdigest(content)}-{added_tokens}"
    return lambda: kept_in_worker(name, make)


@register("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_dir(spark, "token-shards")
    encoder = tokenizer_encoder(public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)
    return read_shards(write_shards(table(spark, sf_dir, "documents"), folder, encoder))
