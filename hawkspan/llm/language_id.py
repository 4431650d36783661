"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of all labelled texts, task by task in numpy and then per language and bucket in a grouping, so every labelled
document counts. The matrix of log probabilities (languages x buckets, both bounded) is broadcast; texts are scored in numpy, a batch
at a time as one sparse matrix of bucket counts: its entries' rows of the matrix are weighted and summed by text.

At most ``MAX_LANGUAGES`` labels are learned, which bounds the matrix: those with the most documents (ties: in alphabetical order). Rows
with other labels take no part in training.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be learned. Equal
posteriors go to the first language in alphabetical order. Repeated rows count and are scored each. Extra columns pass through
``predict``, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkspan.llm.base import register, table

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 200
ENTRIES = 1 << 18  # of a sparse matrix that is scored at once, beyond a text's own
PIECE = 1 << 18  # code points of a text that are hashed at once
SMOOTHING = 0.5
LETTER = regex.compile(r"\p{L}")
MULTIPLIERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the whole text, lower-cased, and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    reach = max(ORDERS) - 1
    for begin in range(0, len(codes), PIECE):  # pieces overlap, each n-gram begins in one
        piece = codes[begin : begin + PIECE + reach]
        for n in ORDERS:
            starts = min(PIECE, len(piece) - n + 1)
            if starts > 0:
                mixed = np.full(starts, n, np.uint64)
                for k in range(n):
                    mixed = (mixed ^ piece[k : k + starts]) * MULTIPLIERS[k]
                    mixed ^= mixed >> np.uint64(29)
                total += np.bincount((mixed >> np.uint64(16)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used, total[used]


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages

    def scores(self, texts: Iterable[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text."""
        names, values = [], []
        rows: list[tuple[np.ndarray, np.ndarray] | None] = []
        held = 0

        def close() -> None:
            some = [i for i, row in enumerate(rows) if row is not None]
            found, odds = ["und"] * len(rows), np.zeros(len(rows))
            if some:
                entries = [rows[i] for i in some]
                begins = np.concatenate([[0], np.cumsum([len(b) for b, _ in entries[:-1]])]).astype(np.int64)
                buckets, counts = (np.concatenate([e[k] for e in entries]) for k in (0, 1))
                logs = self.log_prior + np.add.reduceat(counts[:, None] * self.log_prob[buckets], begins, axis=0)
                best = logs.argmax(axis=1)
                share = np.exp(logs - logs.max(axis=1, keepdims=True))
                odds[some] = share[np.arange(len(some)), best] / share.sum(axis=1)
                for i, j in zip(some, best.tolist(), strict=True):
                    found[i] = self.languages[j]
            names.extend(found)
            values.append(odds)
            rows.clear()

        for text in texts:
            rows.append(bucket_counts(text) if self.languages and has_letter(text) else None)
            held += len(rows[-1][0]) if rows[-1] is not None else 0
            if held > ENTRIES:
                close()
                held = 0
        close()
        return names, np.concatenate(values)


def train(docs: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Learn from every row of ``docs`` whose label is one of the learned ones and whose text has a letter."""
    rows = docs.select(docs[text].alias("text"), docs[label].cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
    frequent = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LANGUAGES)
    rows = rows.where(F.col("label").isin(*[r.label for r in frequent.collect()]))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            for text_, label_ in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                if has_letter(text_):
                    if label_ not in counts:
                        counts[label_], documents[label_] = np.zeros(BUCKETS, np.int64), 0
                    buckets, n = bucket_counts(text_)
                    counts[label_][buckets] += n
                    documents[label_] += 1
        for label_, vector in counts.items():
            used = np.flatnonzero(vector)
            yield pa.RecordBatch.from_pydict({"label": [label_] * (len(used) + 1), "bucket": pa.array(np.append(used, -1), pa.int32()), "n": pa.array(np.append(vector[used], documents[label_]), pa.int64())})

    sums = rows.mapInArrow(count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))  # at most BUCKETS + 1 cells each
    found = {}
    for row in packed.toLocalIterator():
        cells = np.array(row.cells, np.int64)
        found[row.label] = cells
    languages = sorted(found)
    matrix, prior = np.full((BUCKETS, len(languages)), SMOOTHING), np.zeros(len(languages))
    for j, language in enumerate(languages):
        cells = found[language]
        ngrams = cells[cells[:, 0] >= 0]
        matrix[ngrams[:, 0], j] += ngrams[:, 1]
        prior[j] = cells[cells[:, 0] < 0, 1].sum()
    return Model(languages, np.log(prior / max(prior.sum(), 1)), np.log(matrix / matrix.sum(axis=0)))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc`` (all of the row's columns), lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prior, model.log_prob))

    @F.pandas_udf("lang_pred string, score double")
    def scored(texts):
        import pandas as pd

        names, values = Model(*shared.value).scores(texts)
        return pd.DataFrame({"lang_pred": names, "score": values})

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), scored(docs[text]).alias("language"))
    return rows.select("doc", "language.lang_pred", "language.score")


def remainder(identifier: Column) -> Column:
    return F.crc32(identifier.cast("string").cast("binary")) % 3


def crc_remainder(identifier: int) -> int:
    return zlib.crc32(str(identifier).encode()) % 3


@register("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    model = train(docs.where(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc.doc_id", "doc.held_out", "lang_pred", "score")
