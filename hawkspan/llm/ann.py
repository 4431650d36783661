"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is normalised, centred and rotated at random; the signs of its coordinates are its code. With two correction scalars, the
length of the centred vector and the inner product of its direction with its code, the code gives an unbiased estimate of any inner
product and a bound on its error. A query keeps, per block of the index, the vectors whose upper bound is not below the k-th lower
bound, and only those are measured exactly, in double precision.

Queries meet the index in blocks: sets of queries and groups of the index, both of bounded size, are paired by an equi-join, each pair is
one task's work in numpy, and k rows per query and group go on to the final top k.

Defined cases: vectors that are null, zero, of another length than the most frequent one, or hold null or non-finite components take no
part; equal scores go to the smaller identifier; fewer candidates than k give all of them; repeated identifiers count as one row each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hawkspan.llm.base import register, table
from hawkspan.session import stored

QUERY_BLOCK, INDEX_BLOCK = 512, 4096
CONFIDENCE = 2.5  # the error bound holds for all but about one estimate in eighty
HIT = "query_id bigint, vec_id bigint, score double"


def rotation(size: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def valid_vectors(rows: DataFrame, identifier: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = rows[vector].cast("array<double>")
    picked = rows.select(rows[identifier].cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = picked.where(finite & F.exists("v", lambda x: x != 0))
    common = picked.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1)
    return picked.join(F.broadcast(common.select("size")), F.size("v") == F.col("size"), "left_semi")  # one row


def build_index(vectors: DataFrame, seed: int = 7) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Index rows (block, vec_id, code, length, fit, v), the centre and the rotation. The centre is the mean direction of all vectors."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                unit, _ = _units(batch["v"])
                total, n = total + unit.sum(axis=0), n + len(unit)
        if n:
            yield pa.RecordBatch.from_pydict({"total": [total.tolist()], "n": pa.array([n], pa.int64())})

    parts = vectors.mapInArrow(sums, "total array<double>, n bigint")
    cells = parts.select("n", F.posexplode("total").alias("at", "x")).groupBy("at").agg((F.sum("x") / F.sum("n")).alias("mean")).orderBy("at").collect()  # one row per dimension
    centre = np.array([c["mean"] for c in cells])
    turn = rotation(len(centre), seed) if len(centre) else np.zeros((0, 0))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit, norms = _units(batch["v"])
                moved = (unit - centre) @ turn
                length = np.linalg.norm(moved, axis=1)
                bits = moved > 0
                fit = np.abs(moved).sum(axis=1) / np.where(length > 0, length, 1) / np.sqrt(moved.shape[1])
                codes = np.packbits(bits, axis=1)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(fit), pa.array(norms), batch["v"]], ["vec_id", "code", "length", "fit", "norm", "v"])

    index = vectors.mapInArrow(encode, "vec_id bigint, code binary, length double, fit double, norm double, v array<double>")
    return stored(index, "ann-index"), centre, turn


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; scaled first, so that neither huge nor tiny components overflow."""
    v = _matrix(column)
    scale = np.abs(v).max(axis=1, keepdims=True)
    norms = np.sqrt(((v / scale) ** 2).sum(axis=1, keepdims=True))
    return v / scale / norms, (scale * norms)[:, 0]


def _search_block(query_ids, queries, ids, codes, lengths, fits, vectors, centre, turn, k):
    """Hits (query, id, cosine) of one block of queries in one block of the index."""
    size = len(centre)
    signs = np.unpackbits(codes, axis=1, count=size).astype(np.float32) * np.float32(2 / np.sqrt(size)) - np.float32(1 / np.sqrt(size))
    moved = (queries - centre) @ turn
    reach = np.linalg.norm(moved, axis=1, keepdims=True)
    safe = np.maximum(fits, 1e-12)
    estimate = (moved.astype(np.float32) @ signs.T) * (lengths / safe)
    error = reach * (lengths * np.sqrt(np.maximum(1 - fits**2, 0)) / safe) * (CONFIDENCE / np.sqrt(max(size - 1, 1))) + 1e-5
    # cosine = <q - c, o - c> + <q, c> + <o, c> - <c, c>; <o, c> is known exactly for each vector
    shift = (queries @ centre)[:, None] + (vectors @ centre)[None, :] - centre @ centre
    low, high = estimate - error + shift, estimate + error + shift
    own = query_ids[:, None] == ids[None, :]
    low[own], high[own] = -np.inf, -np.inf
    out = []
    for i in range(len(query_ids)):
        n = min(k, len(ids))
        bar = np.partition(low[i], len(ids) - n)[len(ids) - n]
        chosen = np.flatnonzero((high[i] >= bar) & ~own[i])
        scores = (vectors[chosen] * queries[i]).sum(axis=1)
        best = np.lexsort((ids[chosen], -scores))[:k]
        out.append((np.full(len(best), query_ids[i]), ids[chosen[best]], scores[best]))
    return out


def search(index: DataFrame, centre: np.ndarray, turn: np.ndarray, is_query, k: int = 5, groups: int | None = None, sets: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row that ``is_query`` names, against all rows of the index.

    ``groups`` of the index and ``sets`` of queries follow from their numbers: some 16,000 vectors and 4,000 queries at most meet in a task.
    """
    counted = index.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("asked")).head()
    groups = groups or max(1, -(-counted["n"] // (4 * INDEX_BLOCK)))
    sets = sets or max(1, -(-counted["asked"] // (8 * QUERY_BLOCK)))

    def dealt(rows: DataFrame, own: str, number: int, other: str, others: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(number)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    salted = dealt(index, "group", groups, "set", sets)
    asked = dealt(index.where(is_query).select("vec_id", "v"), "set", sets, "group", groups)

    def work(key, left, right):
        ids, answers = right["vec_id"].to_numpy(), []
        order = np.argsort(ids, kind="stable")
        units = _units(right["v"].combine_chunks())[0][order]
        ids = ids[order]
        codes = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        lengths, fits = right["length"].to_numpy()[order], right["fit"].to_numpy()[order]
        if left.num_rows:
            query_ids, q = left["vec_id"].to_numpy(), _units(left["v"].combine_chunks())[0]
            for a in range(0, len(query_ids), QUERY_BLOCK):
                for b in range(0, len(ids), INDEX_BLOCK):
                    s, t = slice(a, a + QUERY_BLOCK), slice(b, b + INDEX_BLOCK)
                    answers += _search_block(query_ids[s], q[s], ids[t], codes[t], lengths[t], fits[t], units[t], centre, turn, k)
        columns = [np.concatenate(c) for c in zip(*answers, strict=True)] if answers else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    hits = asked.groupBy("group", "set").cogroup(salted.groupBy("group", "set")).applyInArrow(lambda key, left, right: work(key, left, right) if right.num_rows else work_nothing(), HIT)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def work_nothing() -> pa.Table:
    return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


@register("op4_ann")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, centre, turn = build_index(valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return search(index, centre, turn, F.col("vec_id") % 50 == 0)
