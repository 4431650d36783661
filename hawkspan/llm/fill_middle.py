"""Fill-in-the-middle: documents cut in three and put together as prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``).

A slice of an Arrow batch is one run of bytes. A scan finds code point starts, cuts and literal markers; every segment of a document
moves by one distance, so a difference array with an entry per segment, summed up, gives each byte its shift, and one scatter builds
all outputs. Going back, the markers of the outputs give the same segments, and one gather restores the texts.

Cuts are counted in code points and come from the hash of ``<seed>:<identifier>``, so a repeated task gives the same output.

Defined cases: a null text counts as empty; an empty text, or one that holds a marker, stays ``plain``; a null identifier hashes as
``<seed>:``; rows that repeat come out each; an empty table gives an empty result; other columns are ignored, whatever their names. A
document lies in memory whole, about 15 bytes for each of its own. An output without its three markers in the order of its form restores to null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hawkspan.llm.base import register, table

P, S, M = (ord(c) for c in "PSM")  # the markers are <P>, <S> and <M>
SLICE_BYTES = 2_000_000
MADE = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
FORMS = np.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one run, and where each value begins in it (and the last one ends)."""
    wide = column.cast(pa.large_binary())
    at = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def _strings(data: np.ndarray, at: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    nulls = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data), nulls)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``SLICE_BYTES``, one row at least."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > SLICE_BYTES:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def _markers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, letter) of every marker that lies within a document."""
    where = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")))
    letter = data[where + 1] if len(where) else np.zeros(0, np.uint8)
    ours = (letter == P) | (letter == S) | (letter == M)
    where, letter = where[ours], letter[ours]
    doc = np.searchsorted(at, where, "right") - 1
    inside = where + 3 <= at[doc + 1]
    return doc[inside], where[inside], letter[inside]


def _shifts(total: int, starts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The shift of every byte, given those of segments in order of their starts; of segments that start together the last one counts."""
    difference = np.zeros(total + 1, np.int64 if total > 2**30 else np.int32)
    np.add.at(difference, starts, np.diff(shifts, prepend=0).astype(difference.dtype))
    return np.cumsum(difference[:-1], dtype=difference.dtype)


def scatter(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, rate: int, suffix_first: int):
    """Outputs of the documents ``data[at[i]:at[i + 1]]``; ``hashes`` has four columns. Gives n, form, prefix and middle sizes, bytes, places."""
    docs, size = len(at) - 1, np.diff(at)
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(begins, at)
    n = np.diff(first)
    form = np.where(hashes[:, 2] % 100 >= rate, PLAIN, np.where(hashes[:, 3] % 100 < suffix_first, SPM, PSM))
    form[n == 0] = PLAIN
    form[_markers(data, at)[0]] = PLAIN
    one, two = hashes[:, 0] % (n + 1), hashes[:, 1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    cut1, cut2 = begins[first[:-1] + low], begins[first[:-1] + high]
    prefix, suffix = cut1 - at[:-1], at[1:] - cut2
    made = form != PLAIN
    out_at = np.concatenate([[0], np.cumsum(size + 9 * made)])
    begin, psm = out_at[:-1], form == PSM
    to_prefix = begin + np.where(psm, 3, 6 + suffix) * made
    to_suffix = begin + np.where(psm, 6 + prefix, 3)
    to_middle = begin + 9 + prefix + suffix
    targets = np.stack([to_prefix - at[:-1], np.where(made, to_middle - cut1, begin - at[:-1]), np.where(made, to_suffix - cut2, begin - at[:-1])], 1)
    starts = np.stack([at[:-1], cut1, cut2], 1)
    out = np.empty(out_at[-1], np.uint8)
    shift = _shifts(len(data), starts.ravel(), targets.ravel())
    shift += np.arange(len(data), dtype=shift.dtype)
    out[shift] = data
    for letter, place in ((P, to_prefix - 3), (S, to_suffix - 3), (M, to_middle - 3)):
        for i, byte in enumerate((ord("<"), letter, ord(">"))):
            out[place[made] + i] = byte
    return n, form, np.where(made, low, -1), np.where(made, high - low, -1), out, out_at


def gather(data: np.ndarray, at: np.ndarray, form: np.ndarray):
    """The texts behind the outputs: bytes, places, and which of them are well formed."""
    docs = len(at) - 1
    doc, where, letter = _markers(data, at)
    places = np.zeros((docs, 3), np.int64)
    count = np.bincount(doc, minlength=docs)
    keep = count[doc] == 3
    full = np.flatnonzero(count == 3)
    places[full] = where[keep].reshape(-1, 3)
    letters = np.zeros((docs, 3), np.uint8)
    letters[full] = letter[keep].reshape(-1, 3)
    made, psm = form != PLAIN, form == PSM
    order = np.where(psm[:, None], np.array([[P, S, M]], np.uint8), np.array([[S, P, M]], np.uint8))
    valid = ~made | ((letters == order).all(1) & (places[:, 0] == at[:-1]))
    first, second, third = (places + 3).T
    p_from, p_size = np.where(psm, first, second), np.where(psm, second - first, third - second) - 3
    s_from, s_size = np.where(psm, second, first), np.where(psm, third - second, second - first) - 3
    use = made & valid
    p_from, p_size = np.where(use, p_from, at[:-1]), np.where(use, p_size, 0)
    s_from, s_size = np.where(use, s_from, at[1:]), np.where(use, s_size, 0)
    m_from = np.where(use, third, at[:-1])
    size = np.where(valid, np.diff(at) - 9 * made, 0)
    back_at = np.concatenate([[0], np.cumsum(size)])
    starts = np.stack([back_at[:-1], back_at[:-1] + p_size, back_at[1:] - s_size], 1)
    shift = _shifts(back_at[-1], starts.ravel(), (np.stack([p_from, m_from, s_from], 1) - starts).ravel())
    shift += np.arange(len(shift), dtype=shift.dtype)
    return data[shift], back_at, valid


def rearrange(docs: DataFrame, text: str = "text", identifier: str = "doc_id", seed: int = 1, rate: int = 90, suffix_first: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output. ``rate`` per cent of the texts are cut, ``suffix_first`` per cent of those as spm."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(docs[identifier].cast("bigint").cast("string"), F.lit("")))
    hashed = docs.select(docs[identifier].cast("bigint").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"), F.sha2(named, 256).alias("sha"))
    rows = hashed.select("doc_id", "text", *[F.conv(F.substring("sha", 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(_bytes(batch["text"])[1])
            for low, high in _slices(sizes):
                part = batch.slice(low, high - low)
                hashes = np.stack([part[f"h{i + 1}"].to_numpy() for i in range(4)], 1)
                n, form, prefix, middle, out, out_at = scatter(*_bytes(part["text"]), hashes, rate, suffix_first)
                plain = form == PLAIN
                columns = [part["doc_id"], pa.array(n, pa.int64()), pa.array(FORMS[form].tolist(), pa.string()), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), _strings(out, out_at)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in MADE.split(", ")])

    return rows.mapInArrow(cut, MADE)


def restore(made: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """The rows of ``made`` with a column ``restored``, the text rebuilt from output and form alone."""
    schema = T.StructType([*made.schema.fields, T.StructField("restored", T.StringType())])

    def back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(_bytes(batch[output])[1])
            for low, high in _slices(sizes):
                part = batch.slice(low, high - low)
                forms = part[form].to_pylist()
                known = np.array([f in FORMS for f in forms]) & ~np.asarray(part[output].is_null())
                data, at = _bytes(part[output])
                texts, text_at, valid = gather(data, at, np.array([max(0, list(FORMS).index(f)) if f in FORMS else PLAIN for f in forms]))
                yield pa.RecordBatch.from_arrays([*part.columns, _strings(texts, text_at, valid & known)], [*part.schema.names, "restored"])

    return made.mapInArrow(back, schema)


@register(
    "op12_fill_middle",
    """WITH hashed AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS sha FROM documents),
    numbers AS (
        SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(sha, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(sha, 9, 8) AS BIGINT) AS h2,
            CAST('0x' || substr(sha, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(sha, 25, 8) AS BIGINT) AS h4 FROM hashed),
    cuts AS (
        SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM numbers),
    made AS (
        SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cuts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM made""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(rearrange(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
