"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Each byte string of the vocabulary becomes a piece spelled in printable characters, one a byte, with its negative rank as score; the
normaliser is the identity and no space is added, removed or escaped. Merging the highest-scored neighbours first is then merging the
lowest ranks first. Pre-tokens are encoded one by one (one that is in the vocabulary as a whole is its own id, as the ranks' own
library has it), and ids are decoded by mapping each piece's characters back to bytes.

Defined cases: a null or empty text has no ids and decodes to nothing; rows that repeat give equal results; an empty table gives an
empty result; extra columns are ignored in the digest query.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkspan.llm.base import register, table
from hawkspan.llm.chunks import ChunkMemory, kept_in_worker, slices

ENCODED = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's byte strings in rank order (a bounded file)."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return tokens


def byte_characters() -> list[str]:
    """A printable character per byte: visible Latin-1 bytes stand for themselves, the others follow from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol-buffer field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece i is token i; the unknown piece comes last."""
    letters = byte_characters()
    pieces = [_field(1, "".join(letters[b] for b in token).encode()) + _field(2, -float(rank)) for rank, token in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(24, 0)  # BPE, size, unknown id, white space not split off
    for number in (41, 42, 43):  # no begin, end and padding ids
        trainer += _varint(number << 3) + _varint(2**64 - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes texts; one per Python worker."""

    def __init__(self, model: bytes, pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        letters = byte_characters()
        size = self.model.get_piece_size() - 1
        values = {c: b for b, c in enumerate(letters)}
        self.table = [bytes(map(values.__getitem__, self.model.id_to_piece(i))) for i in range(size)]
        self.whole = {token: i for i, token in enumerate(self.table)}
        self.spell = {b: letters[b] for b in range(256)}
        self.memory = ChunkMemory(pattern, self._pretokens)

    def _pretokens(self, pieces: list[str]) -> list[list[int]]:
        raw = [p.encode() for p in pieces]
        spelled = self.model.encode([r.decode("latin-1").translate(self.spell) for r in raw], num_threads=1)
        return [[self.whole[r]] if r in self.whole else ids for r, ids in zip(raw, spelled, strict=True)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return self.memory.encoded_array(texts)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


def _mapped(docs: DataFrame, vocabulary: str, text: str, identifier: str, schema: str, row: Callable) -> DataFrame:
    import public_tokenizers

    spark = docs.sparkSession
    content = model_bytes(read_ranks(vocabulary))
    name, model = f"sentencepiece-{xxhash.xxh3_128_hexdigest(content)}", spark.sparkContext.broadcast(content)  # as large as the vocabulary file
    pattern = public_tokenizers.PATTERN

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or kept_in_worker(name, lambda: Codec(model.value, pattern))
            for low, high in slices(batch["text"]):
                part = batch.slice(low, high - low)
                rows = [(doc_id, len(ids), *row(codec, ids)) for doc_id, ids in zip(part["doc_id"].to_pylist(), codec.encode(part["text"]), strict=True)]
                kinds = [pa.int64(), pa.int64(), *[pa.binary() if "binary" in schema else pa.string()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    rows = docs.select(docs[identifier].cast("bigint").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return rows.mapInArrow(encode, schema)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the bytes they decode to."""
    return _mapped(docs, vocabulary, text, identifier, ENCODED, lambda codec, ids: (ids.tobytes(), codec.decode(ids.tolist())))


def _digests(codec: Codec, ids: np.ndarray) -> tuple[str, str]:
    numbers = ids.tolist()
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest(), hashlib.sha256(codec.decode(numbers)).hexdigest()


def digest_documents(docs: DataFrame, vocabulary: str, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded bytes."""
    return _mapped(docs, vocabulary, text, identifier, DIGESTS, _digests)


@register("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
