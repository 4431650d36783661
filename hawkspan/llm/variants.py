"""Spelling variants: words one letter apart, each led to the more frequent form.

Words are filed by length and by the sums of their letter counts over a few classes of letters. One edit changes one or two of those
sums by one, so a cell of this grid meets itself and the cells that such a step leads to: those of its own length and of the next.
Cells are dealt into blocks of bounded size; for two blocks that meet, a NumPy product of their letter-count matrices (a blocked Gram
matrix) gives all squared distances. Pairs at most two apart are kept and verified letter by letter, all pairs of a block at once. The
number of classes grows with the vocabulary, so that a cell holds about a thousand words: work grows with the vocabulary, not with its
square, and the pairs are the same with any number of classes.

Defined cases: a null text has no words; a null identifier hashes as an empty one; rows that repeat count each; an empty table gives an
empty result; other columns are ignored, whatever their names; ties of frequency go to the smaller word in code point order.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkspan.llm.base import register, table
from hawkspan.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])  # what a word may hold, lower-cased
BLOCK_WORDS, BLOCK_BYTES, CELL_WORDS, VERIFY_BYTES = 2_000, 4_000_000, 1_000, 8_000_000
FILED = "word string, n bigint, length int, cell binary"
PAIRS = "a string, a_n bigint, b string, b_n bigint"


def noisy_words(docs: DataFrame, text: str = "text", identifier: str = "doc_id", least: int = 6, spoil: int = 199) -> DataFrame:
    """(word) of every run of letters, A to Z lower-cased, ``least`` code points long at least. Where ``spoil`` divides the run's hash, a letter is left out (0: nowhere)."""
    runs = docs.select(F.coalesce(docs[identifier].cast("bigint").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(docs[text], F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))).alias("run"))
    ascii_ = F.octet_length("run") == F.length("run")
    lowered = runs.select("id", F.when(ascii_, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    if not spoil:
        return lowered.select(F.col("run").alias("word"))
    hashed = lowered.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run").cast("bigint")).cast("int")
    spoilt = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % spoil == 0, spoilt).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def classes_for(words: int) -> int:
    """Classes of letters that leave about ``CELL_WORDS`` words in a cell: each class more divides cells by about three."""
    return max(1, min(20, round(math.log(max(1, words / (2 * CELL_WORDS)), 3))))


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points (all below 256)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def counts(rows: np.ndarray) -> np.ndarray:
    """Letter counts of each row, in a type that holds sums of squares exactly."""
    place = np.zeros(256, np.int64)
    place[ALPHABET] = np.arange(len(ALPHABET))
    size = len(ALPHABET)
    flat = np.bincount((place[rows] + size * np.arange(len(rows))[:, None]).ravel(), minlength=size * len(rows))
    return flat.reshape(len(rows), size).astype(np.float32 if rows.shape[1] < 2000 else np.float64)


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (as long, or longer by one) exactly one edit apart; of a block with itself each pair once."""
    x, y = counts(a), counts(b)
    distances = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(distances <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    width, step = a.shape[1], max(1, VERIFY_BYTES // a.shape[1])
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), step):
        p, q = a[i[at : at + step]], b[j[at : at + step]]
        if a.shape[1] == b.shape[1]:
            keep[at : at + step] = (p != q).sum(1) == 1
        else:
            front = np.logical_and.accumulate(p == q[:, :width], axis=1).sum(1)
            back = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(1)
            keep[at : at + step] = front + back >= width
    return i[keep], j[keep]


def _file(vocabulary: DataFrame, classes: int) -> DataFrame:
    """Each word with its length and cell: its number of letters in every class, four bytes each."""

    def file(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            cells = [np.bincount(np.frombuffer(w.encode("latin-1"), np.uint8) % classes, minlength=classes).astype(">u4").tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(map(len, words), pa.int32()), pa.array(cells, pa.binary())], ["word", "n", "length", "cell"])

    return vocabulary.select("word", "n").mapInArrow(file, FILED)


def _meetings(cells: DataFrame) -> DataFrame:
    """(cell, other): the cells that one edit may lead to, every two cells once. The length is the sum of the counts."""

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch["cell"].to_pylist():
                own = np.frombuffer(cell, ">u4").astype(np.int64)
                unit = np.eye(len(own), dtype=np.int64)
                steps = [own, *(own + unit), *(own + unit[i] - unit[j] for i in range(len(own)) for j in range(i + 1, len(own)))]
                others = [s.astype(">u4").tobytes() for s in steps if s.min() >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([cell] * len(others), pa.binary()), pa.array(others, pa.binary())], ["cell", "other"])

    return cells.select("cell").mapInArrow(meet, "cell binary, other binary")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two words of the vocabulary (word, n) that are exactly one edit apart, once."""
    filed = stored(_file(vocabulary, classes_for(vocabulary.count())), "variants-filed")
    room = F.least(F.lit(BLOCK_WORDS), F.greatest(F.lit(1), F.lit(BLOCK_BYTES) / F.col("length")))
    cells = stored(filed.groupBy("cell").agg(F.count(F.lit(1)).alias("words"), F.first("length").alias("length")).select("cell", F.ceil(F.col("words") / room).alias("blocks")), "variants-cells")
    dealt = filed.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    blocks = stored(dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("word", "n")).alias("words")), "variants-blocks")
    met = _meetings(cells).join(cells.select(F.col("cell").alias("other")), "other")
    first = met.join(blocks.select("cell", F.col("block"), F.col("words").alias("these")), "cell")
    second = blocks.select(F.col("cell").alias("other"), F.col("block").alias("other_block"), F.col("words").alias("those"))
    pairs = first.join(second, "other").where("cell <> other OR block <= other_block")
    itself = (F.col("cell") == F.col("other")) & (F.col("block") == F.col("other_block"))
    tasks = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pairs.select(itself.alias("itself"), "these", "those", F.xxhash64("cell", "block", "other", "other_block").alias("pair")).repartition(4 * tasks, "pair")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                these, those = batch["these"][k].values, batch["those"][k].values
                a, b = these.field("word").to_pylist(), those.field("word").to_pylist()
                i, j = near_pairs(letters(a), letters(b), batch["itself"][k].as_py())
                if len(i):
                    yield pa.RecordBatch.from_arrays([these.field("word").take(pa.array(i)), these.field("n").take(pa.array(i)), those.field("word").take(pa.array(j)), those.field("n").take(pa.array(j))], ["a", "a_n", "b", "b_n"])

    return spread.mapInArrow(compare, PAIRS)


def variants(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary (word, n). A form is ``ratio`` times as frequent at least."""
    pairs = near_words(vocabulary)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    around = pairs.select(sides.alias("x")).select("x.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near"))).alias("best"))
    told = vocabulary.select("word", "n").join(around, "word", "left")
    enough = -F.col("best.rank") >= ratio * F.col("n")
    formed = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.rank")).alias("form_n")), "variants-forms")

    # A form is more frequent than its word, so chains end; each round doubles how far a word has followed its own.
    hops = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = stored(hops.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        if hops.where("moved").isEmpty():
            break
        hops = hops.select("word", "root")
    return formed.join(hops.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary_of(docs: DataFrame, occurrences: int = 5, **options) -> DataFrame:
    """(word, n) of the words that occur often enough, stored."""
    return stored(noisy_words(docs, **options).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences), "variants-vocabulary")


@register(
    "op11_spelling_variants",
    r"""WITH RECURSIVE crc AS (  -- the CRC-32 table: eight shifts of each byte
        SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
    runs AS (
        SELECT CAST(doc_id AS VARCHAR) AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    counted AS (
        SELECT coalesce(id, '') AS id, run, count(*) AS n FROM runs GROUP BY ALL),
    hashed AS (
        SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(id || ':' || run)) * 2, 2), lambda p: CAST('0x' || substr(hex(encode(id || ':' || run)), p + 1, 2) AS BIGINT))), lambda c, b: xor(crc.t[xor(c, b) % 256 + 1], c // 256))) AS h
        FROM counted, crc),
    spoilt AS (
        SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    holes AS (
        SELECT word, n, length(word) AS l, i, substring(word, 1, i - 1) AS head, substring(word, i + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (
        SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.l = b.l AND a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.head || a.tail = b.word
        UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.head || a.tail = b.word),
    best AS (
        SELECT word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS other FROM near GROUP BY word),
    formed AS (
        SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN other END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n FROM words w LEFT JOIN best USING (word)),
    chain AS (
        SELECT word, word AS at, form FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.form = f.word)
    SELECT word, f.form, c.at AS root, n, n_near, form_n FROM formed f JOIN chain c USING (word) WHERE c.form IS NULL""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary_of(table(spark, sf_dir, "documents")))
