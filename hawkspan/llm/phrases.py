"""Repeated passages: every word that lies in a window of words which also starts in a document with a smaller identifier goes.

Whole windows are too many for a dictionary, so it holds short phrases: in each window the phrase with the smallest hash. Equal windows
choose equal phrases, hence a window that occurs in two documents holds a phrase that is chosen in both. In steps:

1. Equal texts become one, with its smallest identifier. The task that receives them writes them into shards in the shared folder and
   gives out the chosen phrases with the shard's name.
2. Phrases, compared as text, that occur in two documents are confirmed, and go back to the shards that hold them.
3. Each shard compiles its confirmed phrases into an Aho-Corasick automaton and streams all its documents through it. Windows around
   the places found are the candidates; they are given out by a 128-bit hash with the shard's smallest and largest identifier.
4. Windows that occur in two documents go back to their shards with the smallest identifier, and the words they cover go.

An automaton's size is bounded by its shard's, so nothing grows with the corpus but the number of shards. A passage in a third of all
documents is one row per shard in steps 2 and 4. Texts are shuffled once. Windows of equal 128-bit hash count as equal.

Defined cases: a null text has no words; texts with fewer words than a window lose none; of rows with one identifier none takes words
from another; a null identifier keeps all its words and takes none from others; repeated rows come out each; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import array
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hawkspan.llm.base import register, table, work_dir
from hawkspan.llm.chunks import kept_in_worker
from hawkspan.llm.token_files import open_folder
from hawkspan.session import stored

PHRASE_WORDS, SHARD_BYTES, WORDS_KEPT = 10, 8_000_000, 400_000
CHOSEN = "shard string, phrase binary, lo bigint, hi bigint"
FOUND = "shard string, h1 bigint, h2 bigint, lo bigint, hi bigint"
RESULT = "key binary, named boolean, first bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
NO_ID = -(2**63)  # stands for a null identifier in a shard
ODD = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03  # multipliers of the two rolling hashes: any odd numbers with well mixed bits


class Digests(dict):
    """Word to its 128-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = digest = xxhash.xxh3_128_digest(word)
        return digest


class Rolling:
    """Hashes of all runs of ``length`` consecutive words, from the hashes of words: differences of one running sum, modulo 2 ** 64."""

    def __init__(self, odd: int):
        self.odd, self.powers, self.inverse = odd, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def runs(self, words: np.ndarray, length: int) -> np.ndarray:
        if len(self.powers) < len(words):
            self.powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * len(words), o, np.uint64)]), dtype=np.uint64) for o in (self.odd, pow(self.odd, -1, 2**64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.powers[: len(words)], dtype=np.uint64)])
        mixed = (sums[length:] - sums[:-length]) * self.inverse[: len(words) - length + 1]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ (mixed >> np.uint64(32))


def word_hashes(words: list[bytes], digests: Digests) -> np.ndarray:
    return np.frombuffer(b"".join(map(digests.__getitem__, words)), "<u8").reshape(-1, 2)


def _sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """The smallest (or largest) of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = choose(values[:-step], values[step:])
        have += step
    return values


def chosen(hashes: np.ndarray, per_window: int) -> np.ndarray:
    """Places whose value is the smallest of some ``per_window`` consecutive ones (all of them, if several are)."""
    least = _sliding(hashes, per_window, np.minimum)
    edge = np.zeros(per_window - 1, hashes.dtype)
    return np.flatnonzero(hashes == _sliding(np.concatenate([edge, least, edge]), per_window, np.maximum))


# A shard: one zstandard frame per document, each after its length, the document's identifier and its key.
HEAD, HEAD_BYTES = "<Iq32s", 44


class Shard:
    """Writes documents to a file that gets its name when it is whole."""

    def __init__(self, folder: str):
        self.files, where = open_folder(folder)
        self.files.create_dir(where, recursive=True)
        name = uuid.uuid4().hex
        self.path, self.hidden, self.final, self.size = f"{folder}/{name}.txt.zst", f"{where}/.{name}", f"{where}/{name}.txt.zst", 0
        self.out, self.packer = self.files.open_output_stream(self.hidden), zstandard.ZstdCompressor(level=3)

    def add(self, doc_id: int, key: bytes, words: bytes) -> None:
        frame = self.packer.compress(words)
        self.out.write(struct.pack(HEAD, len(frame), doc_id, key) + frame)
        self.size += len(words)

    def close(self) -> None:
        self.out.close()
        self.files.move(self.hidden, self.final)


def shard_documents(path: str) -> Iterator[tuple[int, bytes, bytes]]:
    """(identifier, key, words joined by single spaces) of a shard's documents, one in memory at a time."""
    files, where = open_folder(path)
    unpacker = zstandard.ZstdDecompressor()
    with files.open_input_stream(where, compression=None) as stream:
        while head := stream.read(HEAD_BYTES):
            size, doc_id, key = struct.unpack(HEAD, head)
            yield doc_id, key, unpacker.decompress(stream.read(size))


def write_shards(texts: DataFrame, folder: str, window: int) -> DataFrame:
    """Step 1: shards of (key, first, content), and the phrases they choose; a row without a phrase stands for the shard itself."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, (rolling, _) = kept_in_worker("phrases", lambda: (Digests(), [Rolling(odd) for odd in ODD]))
        shard, phrases = None, {}

        def finish() -> pa.RecordBatch:
            shard.close()
            rows = [(None, None, None), *((p, lo, hi) for p, (lo, hi) in phrases.items())]
            phrase, lo, hi = zip(*rows, strict=True)
            phrases.clear()
            return pa.RecordBatch.from_arrays([pa.array([shard.path] * len(rows)), pa.array(phrase, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["shard", "phrase", "lo", "hi"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for key, doc_id, content in zip(part["key"].to_pylist(), part["first"].to_pylist(), part["content"].to_pylist(), strict=True):
                    words = content.split()
                    shard = shard or Shard(folder)
                    shard.add(doc_id, key, b" ".join(words))
                    if len(words) >= window and doc_id != NO_ID:
                        runs = rolling.runs(word_hashes(words, digests)[:, 0], PHRASE_WORDS)
                        places = chosen(runs, window - PHRASE_WORDS + 1)
                        for i in places[np.unique(runs[places], return_index=True)[1]].tolist():
                            phrase = b" ".join(words[i : i + PHRASE_WORDS])
                            lo, hi = phrases.get(phrase, (doc_id, doc_id))
                            phrases[phrase] = min(lo, doc_id), max(hi, doc_id)
                    if shard.size > SHARD_BYTES:
                        yield finish()
                        shard = None
        if shard is not None:
            yield finish()

    return stored(texts.select("key", "first", F.col("content").cast("binary").alias("content")).mapInArrow(write, CHOSEN), "phrases-chosen")


def compile_automaton(phrases: Iterable[bytes]) -> ahocorasick.Automaton:
    """Finds whole words only: phrases carry a space on either side. Bytes stand as letters of the same number."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for phrase in phrases:
        automaton.add_word(f" {phrase.decode('latin-1')} ")
    automaton.make_automaton()
    return automaton


def occurrences(automaton: ahocorasick.Automaton, words: bytes) -> np.ndarray:
    """Places in bytes where phrases begin."""
    found = array.array("q", (end - size + 1 for end, size in automaton.iter(f" {words.decode('latin-1')} ")))
    return np.frombuffer(found, np.int64)


def covering(starts: np.ndarray, lengths: np.ndarray, window: int, phrase_words: int) -> np.ndarray:
    """Windows that hold one of the phrases that begin at byte ``starts``; ``lengths``: bytes of each word."""
    word = np.searchsorted(np.cumsum(lengths + 1), starts, "right")
    step = np.zeros(len(lengths) + 2, np.int64)
    np.add.at(step, np.maximum(word + phrase_words - window, 0), 1)
    np.add.at(step, word + 1, -1)
    return np.flatnonzero(np.cumsum(step)[: len(lengths) - window + 1])


def _window_hashes(words: list[bytes], window: int, digests: Digests, rolling: list[Rolling]) -> np.ndarray:
    both = word_hashes(words, digests)
    return np.stack([r.runs(both[:, i], window) for i, r in enumerate(rolling)], 1)


def locate(confirmed: DataFrame, window: int) -> DataFrame:
    """Step 3: the candidate windows of every shard that has confirmed phrases (shard, phrase)."""

    def find(group: pa.Table) -> pa.Table:
        path = group["shard"][0].as_py()
        automaton = compile_automaton(group["phrase"].to_pylist())
        digests, rolling = kept_in_worker("phrases", lambda: (Digests(), [Rolling(odd) for odd in ODD]))
        hashes, ids = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
        for doc_id, _, content in shard_documents(path):
            starts = occurrences(automaton, content)
            if doc_id == NO_ID or not len(starts):
                continue
            words = content.split()
            if len(words) < window:
                continue
            at = covering(starts, np.fromiter(map(len, words), np.int64, len(words)), window, PHRASE_WORDS)
            own = _distinct(_window_hashes(words, window, digests, rolling)[at])
            hashes.append(own)
            ids.append(np.full(len(own), doc_id))
        h, doc = np.concatenate(hashes), np.concatenate(ids)
        order = np.lexsort((doc, h[:, 1], h[:, 0]))
        h, doc = h[order], doc[order]
        begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(1)])) if len(h) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(h)) - 1 if len(h) else begin
        parts = [pa.array(h[begin, i].view(np.int64) if len(begin) else [], pa.int64()) for i in (0, 1)]
        return pa.Table.from_arrays([pa.array([path] * len(begin), pa.string()), *parts, pa.array(doc[begin], pa.int64()), pa.array(doc[end], pa.int64())], ["shard", "h1", "h2", "lo", "hi"])

    return confirmed.groupBy("shard").applyInArrow(find, FOUND)


def _distinct(pairs: np.ndarray) -> np.ndarray:
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    return pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])]


def _earlier(both: np.ndarray, window: int, rolling: list[Rolling], h1: np.ndarray, h2: np.ndarray, first: np.ndarray, doc_id: int) -> np.ndarray:
    """Windows known to start in a document before ``doc_id``; the second half of a hash is only computed for texts where a first half is met."""
    mine = rolling[0].runs(both[:, 0], window).view(np.int64)
    place = np.searchsorted(h1, mine)
    met = np.flatnonzero(h1[np.minimum(place, len(h1) - 1)] == mine)
    if not len(met):
        return met
    place, mine, other = place[met], mine[met], rolling[1].runs(both[:, 1], window).view(np.int64)[met]
    earlier = np.zeros(len(met), bool)
    while True:  # entries of equal first half stand together; there is nearly always one
        here = (place < len(h1)) & (h1[np.minimum(place, len(h1) - 1)] == mine)
        if not here.any():
            return met[earlier]
        at = np.minimum(place, len(h1) - 1)
        earlier |= here & (h2[at] == other) & (first[at] < doc_id)
        place = place + 1


def _cut(repeated: DataFrame, window: int, content: bool) -> DataFrame:
    """Step 4: the result for each text of each shard. ``repeated`` (shard, h1, h2, first), with one row of nulls a shard at least."""

    def cut(group: pa.Table) -> pa.Table:
        path = group["shard"][0].as_py()
        known = group.filter(group["h1"].is_valid())
        h1, h2, first = (known[c].to_numpy() for c in ("h1", "h2", "first"))
        order = np.argsort(h1, kind="stable")
        h1, h2, first = h1[order], h2[order], first[order]
        digests, rolling = kept_in_worker("phrases", lambda: (Digests(), [Rolling(odd) for odd in ODD]))
        rows = []
        for doc_id, key, joined in shard_documents(path):
            words = joined.split()
            kept, removed = joined, 0
            if len(words) >= window and len(h1) and doc_id != NO_ID:
                hit = _earlier(word_hashes(words, digests), window, rolling, h1, h2, first, doc_id)
                if len(hit):
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, hit, 1)
                    np.add.at(step, hit + window, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    removed = int(gone.sum())
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            rows.append((key, doc_id != NO_ID, doc_id, len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if content else None))
        kinds = [pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in RESULT.split(", ")])

    return repeated.groupBy("shard").applyInArrow(cut, RESULT)


def remove_repeats(docs: DataFrame, text: str = "text", identifier: str = "doc_id", window: int = 50, content: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per row of ``docs``, and with ``content`` the words kept, joined by single spaces."""
    if window < 2 * PHRASE_WORDS:
        raise ValueError(f"a window needs {2 * PHRASE_WORDS} words at least")
    spark = docs.sparkSession
    rows = docs.select(docs[identifier].cast("bigint").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("content"))
    rows = rows.select("doc_id", "content", F.col("doc_id").isNotNull().alias("named"), F.unhex(F.sha2("content", 256)).alias("key"))
    # A third of all rows may be copies of one text: each task sends it once.
    texts = rows.groupBy("key", "named").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("first"), F.min("content").alias("content"))
    picked = write_shards(texts, work_dir(spark, "phrase-shards"), window)

    by_phrase = Window.partitionBy("phrase")
    # Rows that name a shard are few bytes and much work, so they are dealt to a number of tasks that follows from the shards.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), picked.where("phrase IS NULL").count() // 4)
    confirmed = picked.where("phrase IS NOT NULL").withColumn("least", F.min("lo").over(by_phrase)).withColumn("most", F.max("hi").over(by_phrase)).where("least < most").select("shard", "phrase")

    by_window = Window.partitionBy("h1", "h2")
    found = locate(confirmed.repartition(tasks, "shard"), window).withColumn("first", F.min("lo").over(by_window)).where("first < hi").select("shard", "h1", "h2", "first")
    all_shards = picked.where("phrase IS NULL").select("shard", *[F.lit(None).cast("bigint").alias(c) for c in ("h1", "h2", "first")])
    results = stored(_cut(found.unionByName(all_shards).repartition(tasks, "shard"), window, content), "phrases-cut")

    copy = F.col("named") & (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window)
    return rows.select("doc_id", "key", "named").join(results, ["key", "named"]).select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if content else []),
    )


@register(
    "op13_repeated_phrases",
    r"""WITH split AS (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    windows AS (
        SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)),
    repeated AS (
        SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id),
    words AS (
        SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split),
    judged AS (
        SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
        FROM words LEFT JOIN (SELECT doc_id, i, i AS hit FROM repeated) r USING (doc_id, i)),
    kept AS (
        SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM judged GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), content=False)
