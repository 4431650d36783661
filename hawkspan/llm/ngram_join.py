"""Similarity join of word n-gram sets under Jaccard similarity, by token-combination prefixes.

Equal sets are one. Tokens (hashed shingles) fall into two classes by how often their bin occurs over all documents. All tokens are
ordered by that, the rarest first. Of a set of n tokens, e may be missing in a partner; the prefix is extended until destroying all its
signatures would take more than e tokens. Signatures are single tokens in the rare class, and pairs of tokens in the frequent one: its
tokens are dealt into groups, and a group with g tokens in the prefix costs a partner g - 1 missing tokens. Two sets that link share
a signature, whichever prefix ends first. As the number of groups has to fit the size of a set, it belongs to a scheme; a set uses the
schemes of its own size band and the next, and sets that link lie in the same band or neighbours.

Candidates are first compared by sketches, counts of a set's tokens in 256 buckets: what two counts differ by adds up to a lower bound of
what the sets differ by, so no link is lost. What is left is verified on whole sets. A signature's sets first meet the smallest of them. What then is not yet connected is compared
pair by pair if few sets share the signature, and otherwise in blocks, inside tasks, from which only connecting links come out: no group
ever gives out all its pairs, and no pair goes unchecked unless it is connected already.

Defined cases: a null or empty text has an empty set and links with nothing; rows that repeat belong to one set; a null identifier takes no
part (component_id is null); an empty table gives an empty result; extra columns are ignored. Shingles and sets are told apart by
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkspan.llm.base import register, table
from hawkspan.llm.components import components
from hawkspan.session import stored

BIN_BITS, CHUNKS, LEVELS = 24, 128, 255  # frequency bins of all documents, dealt to tasks in so many chunks; ranks of bins that tasks get
FREQUENT = 4  # times the mean bin
GROUP = 8  # frequent tokens of a set per group of its scheme
FEW = 32  # sets of a signature that are compared pair by pair
BLOCK = 256  # sets of a block
SLOT_BITS = 23
TILE = 4096
SKETCH = 256  # buckets of a set's sketch
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * M2
    return h ^ (h >> np.uint64(29))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles, A-Z in lower case, words apart by ASCII white space."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    span = min(words, len(parts))
    count = len(parts) - span + 1
    folded = np.full(count, span, np.uint64)
    for k in range(span):
        folded = _mixed((folded + hashed[k : k + count]) * M1)
    return np.unique(folded)


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def sketch(tokens: np.ndarray) -> bytes:
    """Counts of tokens by bucket, at most 255 each."""
    return np.minimum(np.bincount((tokens & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def possible(a: np.ndarray, b: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with these sketches (last axis) and this sum of sizes can link: sketches differ by no more than the sets do."""
    apart = np.abs(a.astype(np.int16) - b).sum(axis=-1, dtype=np.int64)
    return 100 * (total - apart) >= percent * (total + apart)


def _scheme(n: int, percent: int) -> int:
    return int(math.log(n) / -math.log(percent / 100 - 0.01))


def signatures(tokens: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set. ``levels``: the rank of each bin by frequency, ``LEVELS`` if it is frequent."""
    n = len(tokens)
    if n == 0:
        return tokens
    need = n - (percent * n + 99) // 100 + 1
    level = levels[tokens >> np.uint64(64 - BIN_BITS)]
    tokens = tokens[np.argsort(level, kind="stable")]  # tokens come sorted, so ties keep that order
    common = np.sort(level) == LEVELS
    rare = tokens[~common][:need]
    if len(rare) == need:
        return rare
    rest, out = tokens[common], [rare]
    need -= len(rare)
    for scheme in (_scheme(n, percent), _scheme(n, percent) + 1):
        smallest = (percent / 100 - 0.01) ** (1 - scheme)
        seed = np.uint64((scheme + 1) * int(M1) % 2**64)
        if smallest < 2 * GROUP:  # too few tokens for pairs: single ones
            out.append(_mixed(rest[:need] ^ seed))
            continue
        group = _mixed(rest ^ M2) % np.uint64(int(smallest) // GROUP)
        first = np.zeros(len(rest), bool)
        first[np.unique(group, return_index=True)[1]] = True
        end = int(np.searchsorted(np.cumsum(~first), need)) + 1
        order = np.argsort(group[:end], kind="stable")
        ranked, groups = rest[:end][order], group[:end][order]
        lag = 1
        while lag < end and (same := groups[lag:] == groups[:-lag]).any():
            out.append(_mixed(_mixed(ranked[:-lag][same] ^ seed) + ranked[lag:][same] * M1))
            lag += 1
    return np.unique(np.concatenate(out))


def _texts(docs: DataFrame, text: str, identifier: str) -> DataFrame:
    return docs.select(docs[identifier].cast("bigint").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))


def _profile(rows: DataFrame, words: int) -> DataFrame:
    """Per document: doc_id, text_key, set_id, n; and per task: counts of bins, by chunk."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(1 << BIN_BITS, np.uint16)
        for batch in batches:
            ids, sizes, sketches = [], [], []
            for text in batch["text"].to_pylist():
                tokens = shingles(text, words)
                bin_, times = np.unique(tokens >> np.uint64(64 - BIN_BITS), return_counts=True)
                bin_ = bin_.astype(np.int64)
                bins[bin_] = np.minimum(bins[bin_].astype(np.int64) + times, 65535)  # beyond, all are frequent alike
                ids.append(set_id(tokens))
                sizes.append(len(tokens))
                sketches.append(sketch(tokens))
            none = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary()), batch["text_key"]], ["doc_id", "set_id", "n", "sketch", "chunk", "counts", "text_key"])
        pack = zstandard.ZstdCompressor(level=1).compress
        for chunk, part in enumerate(bins.reshape(CHUNKS, -1)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, pa.int64()), "set_id": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "sketch": pa.nulls(1, pa.binary()), "chunk": pa.array([chunk], pa.int32()), "counts": pa.array([pack(part.tobytes())], pa.binary()), "text_key": pa.nulls(1, pa.int64())})

    return stored(rows.mapInArrow(count, "doc_id bigint, set_id bigint, n bigint, sketch binary, chunk int, counts binary, text_key bigint"), "join-profile")


def _bin_levels(profile: DataFrame) -> np.ndarray:
    """The rank of each bin by frequency, in one byte: counts are added chunk by chunk in streams; a fixed number of bins comes back."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for chunk, counts in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                part = np.frombuffer(unpack(counts), np.uint16).astype(np.uint32)
                sums[chunk] = np.minimum(sums[chunk] + part, 1 << 30) if chunk in sums else part
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    rows = profile.where("chunk IS NOT NULL").select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary")
    bins = np.zeros((CHUNKS, (1 << BIN_BITS) // CHUNKS), np.uint32)
    for row in rows.toLocalIterator():
        bins[row.chunk] = np.frombuffer(bytes(row.counts), np.uint32)
    flat = bins.reshape(-1)
    frequent = FREQUENT * flat.mean() + 16
    counted = np.cumsum(np.bincount(np.minimum(flat, 1 << 20)))  # bins with at most so many tokens
    rank = np.minimum(counted * LEVELS // max(int(counted[-1]), 1), LEVELS - 1).astype(np.uint8)
    return np.where(flat > frequent, LEVELS, rank[np.minimum(flat, 1 << 20)]).astype(np.uint8)


def _signature_rows(rows: DataFrame, levels: np.ndarray, words: int, percent: int) -> DataFrame:
    packed = rows.sparkSession.sparkContext.broadcast(levels.tobytes())  # one byte a bin

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(packed.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found, owners, sizes = [], [], []
                for text in batch["text"].slice(at, 1000).to_pylist():
                    tokens = shingles(text, words)
                    name = set_id(tokens)
                    if name in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                    signed = signatures(tokens, flags, percent)
                    found.append(signed)
                    owners.append(np.full(len(signed), name, np.int64))
                    sizes.append(np.full(len(signed), len(tokens), np.int32))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes))], ["sig", "set_id", "n"])

    return stored(rows.select("text").mapInArrow(emit, "sig bigint, set_id bigint, n int"), "join-signatures")


def _whole_sets(rows: DataFrame, involved: DataFrame, words: int) -> DataFrame:
    """(set_id, tokens) of the involved sets. A bitmap of a fixed number of slots tells tasks which documents to look at; a join makes it exact."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SLOT_BITS)) + 1  # from 1: Spark puts slot 0 in a bucket of its own
    marked = involved.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    size = 32768 // 8
    bits = bytearray((1 << SLOT_BITS) // 8)
    for row in marked.toLocalIterator():
        bits[(row.bucket - 1) * size : row.bucket * size] = row.bits
    shared = rows.sparkSession.sparkContext.broadcast(bytes(bits))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            # bit position 0 belongs to slot 1: slots count from one in a bitmap bucket
            place = batch["place"].to_numpy()
            bit = batch["bit"].to_numpy()
            wanted = (flags[place * size + bit // 8] >> (bit % 8).astype(np.uint8)) & 1
            ids, sets = [], []
            for i in np.flatnonzero(wanted).tolist():
                tokens = shingles(batch["text"][i].as_py(), words)
                ids.append((batch["doc_id"][i].as_py(), set_id(tokens)))
                sets.append(tokens.tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "set_id", "tokens"])

    slotted = rows.select("doc_id", "text", (F.bitmap_bucket_number(slot) - 1).alias("place"), F.bitmap_bit_position(slot).alias("bit"))
    built = slotted.mapInArrow(build, "doc_id bigint, set_id bigint, tokens binary")
    return stored(built.join(involved.select("doc_id", "set_id", "n"), ["doc_id", "set_id"]).dropDuplicates(["set_id"]).select("set_id", "n", "tokens"), "join-sets")


def _near_in_size(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _pruned(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches let them link."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("ka", "kb"))
                mask = pa.array(possible(a, b, batch["na"].to_numpy() + batch["nb"].to_numpy(), percent))
                yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    left, right = [sketches.select(F.col("set_id").alias(x), F.col("sketch").alias(f"k{x}"), F.col("n").alias(f"n{x}")) for x in ("a", "b")]
    return stored(pairs.join(right, "b").join(left, "a").select("a", "b", "ka", "kb", "na", "nb").mapInArrow(check, "a bigint, b bigint"), "join-pruned")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["ta"].to_pylist(), batch["tb"].to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                place = np.minimum(np.searchsorted(s, t), len(s) - 1)
                both = int((s[place] == t).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    left, right = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
    return stored(pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint"), "join-links")


def _blocks(members: DataFrame) -> DataFrame:
    """Members (unit, set_id, component, size) dealt to pairs (i, j) of the blocks of their unit."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("unit", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "set_id", "component")


def _hopeful(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The members whose sketch lets them link with a member of another component; sizes counted anew."""

    def compare(key, group):
        i, j = key[1].as_py(), key[2].as_py()
        parts, mine, n = group["component"].to_numpy(), group["mine"].to_numpy(), group["n"].to_numpy()
        counts = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        good = np.zeros(len(n), bool)
        for x in left.tolist():
            able = possible(counts[x], counts[right], n[x] + n[right], percent) & (parts[right] != parts[x])
            good[right[able]] = True
            good[x] |= able.any()
        chosen = group.filter(pa.array(good))
        return pa.table({"unit": chosen["unit"], "set_id": chosen["set_id"], "component": chosen["component"]})

    keyed = _blocks(members).join(sketches, "set_id")
    found = stored(keyed.groupBy("unit", "i", "j").applyInArrow(compare, "unit bigint, set_id bigint, component bigint"), "join-hopeful").distinct()
    return found.join(found.groupBy("unit").agg(F.count(F.lit(1)).alias("size")), "unit")


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect the components of each unit: pairs of blocks of its sets, compared inside tasks."""
    keyed = _blocks(members).join(sets.select("set_id", "tokens"), "set_id")

    def compare(key, group):
        i, j = key[1].as_py(), key[2].as_py()
        names, parts, mine = group["set_id"].to_numpy(), group["component"].to_numpy(), group["mine"].to_numpy()
        sets_ = [np.frombuffer(t, np.uint64) for t in group["tokens"].to_pylist()]
        sizes = np.array([len(s) for s in sets_])
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        _, index, counts = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
        owner, shared = np.repeat(np.arange(len(sets_)), sizes), counts[index] > 1
        column = (np.cumsum(counts > 1) - 1)[index[shared]]
        owner, both = owner[shared], np.zeros((len(left), len(right)), np.float32)
        for begin in range(0, int(column.max(initial=-1)) + 1, TILE):
            inside = (column >= begin) & (column < begin + TILE)
            grid = np.zeros((len(sets_), TILE), np.float32)
            grid[owner[inside], column[inside] - begin] = 1
            both += grid[left] @ grid[right].T
        linked = (100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)) & (parts[left][:, None] != parts[right][None, :])
        root = {p: p for p in parts.tolist()}

        def find(p):
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        out = []
        for x, y in zip(*[a.tolist() for a in np.nonzero(linked)], strict=True):
            p, q = find(int(parts[left[x]])), find(int(parts[right[y]]))
            if p != q:
                root[p] = q
                out.append((int(names[left[x]]), int(names[right[y]])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return stored(keyed.groupBy("unit", "i", "j").applyInArrow(compare, "a bigint, b bigint"), "join-links")


def _units(hits: DataFrame) -> DataFrame:
    """Members of what is compared in blocks: signatures that overlap are taken together where that makes fewer comparisons."""
    edges = hits.where("set_id <> low").select(F.col("low").alias("a"), F.col("set_id").alias("b"))
    cluster = components(edges).withColumnsRenamed({"node": "low", "component": "cluster"})
    apart = hits.groupBy("sig", "low").agg(F.count(F.lit(1)).alias("size")).join(cluster, "low")
    labelled = hits.select("low", "set_id", "component").distinct().join(cluster, "low").select("cluster", "set_id", "component").distinct()
    together = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(apart.groupBy("cluster").agg(F.sum(F.pow("size", F.lit(2))).alias("work")), "cluster")
    whole = together.where("pow(size, 2) <= work").select("cluster", "size")
    one = labelled.join(whole, "cluster").select(F.col("cluster").alias("unit"), "set_id", "component", "size")
    rest = apart.join(whole, "cluster", "left_anti").select("sig", "size")
    return one.unionByName(hits.join(rest, "sig").select(F.col("sig").alias("unit"), "set_id", "component", "size"))


def _told(docs: DataFrame, words: int, percent: int, text: str, identifier: str) -> DataFrame:
    """doc_id, text_key, n of every document; component_id and component_key are those of the first document of its component."""
    rows = _texts(docs, text, identifier)
    profile = _profile(rows, words)
    documents = profile.where("chunk IS NULL").select("doc_id", "text_key", "set_id", "n")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    sets_of = stored(documents.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(first, F.first("n").alias("n")).select("set_id", "first.*", "n"), "join-sets-of")

    signed = _signature_rows(rows.where("doc_id IS NOT NULL"), _bin_levels(profile), words, percent)
    repeated = stored(signed.groupBy("sig").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high").select("sig", "low"), "join-repeated")
    hits = stored(signed.join(repeated, "sig").select("sig", "low", "set_id", "n").distinct(), "join-hits")
    involved = sets_of.join(hits.select("set_id").distinct(), "set_id", "left_semi")
    sketches = stored(profile.where("chunk IS NULL").select("doc_id", "set_id", "n", "sketch").join(involved.select("doc_id", "set_id"), ["doc_id", "set_id"]).dropDuplicates(["set_id"]).select("set_id", "n", "sketch"), "join-sketches")

    def whole(*ids: DataFrame) -> DataFrame:
        named = reduce(DataFrame.unionByName, [d.select(F.col(c).alias("set_id")) for d in ids for c in d.columns]).distinct()
        return _whole_sets(rows, stored(sets_of.join(named, "set_id", "left_semi"), "join-involved"), words)

    size = sketches.select(F.col("set_id").alias("low"), F.col("n").alias("n_low"))
    stars = hits.where("set_id <> low").select("low", "set_id", "n").distinct().join(size, "low").where(_near_in_size("n", "n_low", percent))
    stars = _pruned(stars.select(F.col("low").alias("a"), F.col("set_id").alias("b")), sketches, percent)
    links = _verified(stars, whole(stars), percent)

    # Signatures whose sets are not all connected yet; one of each membership.
    part = components(links).withColumnsRenamed({"node": "set_id"})
    held = hits.join(part, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    open_ = held.groupBy("sig").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("print"))
    open_ = open_.where("c1 <> c2 AND size > 2").groupBy("print", "size").agg(F.min("sig").alias("sig"))
    left = stored(held.join(open_.select("sig", "size"), "sig"), "join-open")

    few = left.where(F.col("size") <= FEW).where("set_id <> low").select("sig", "set_id", "n", "component")
    other = few.withColumnsRenamed({"set_id": "b", "n": "n_b", "component": "component_b"})
    pairs = few.withColumnRenamed("set_id", "a").join(other, "sig").where("a < b AND component <> component_b").where(_near_in_size("n", "n_b", percent)).select("a", "b").distinct()
    pairs = _pruned(pairs, sketches, percent)
    many = stored(_hopeful(_units(left.where(F.col("size") > FEW).select("sig", "low", "set_id", "component")), sketches, percent), "join-members")
    sets = whole(pairs, many.select("set_id"))
    links2 = _verified(pairs, sets, percent)
    links3 = _block_links(many, sets, percent)

    final = components(links.unionByName(links2).unionByName(links3)).withColumnsRenamed({"node": "set_id"})
    named = sets_of.join(final, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = named.groupBy("component").agg(first).select("component", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("component_key"))
    of_set = stored(named.join(smallest, "component").select("set_id", "component_id", "component_key"), "join-components")
    return documents.join(of_set, "set_id", "left")


def ngram_join(docs: DataFrame, words: int = 4, percent: int = 85, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id of every document: the smallest doc_id reachable over links of ``percent`` and more."""
    told = _told(docs, words, percent, text, identifier)
    alone = F.coalesce("component_id", "doc_id")
    return told.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, alone).otherwise(F.col("doc_id"))).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does, the one with the smallest identifier.

    A document is an identifier and a text (told apart by its hash), so texts that share an identifier are decided each by itself; of
    several with the smallest identifier the smallest hash stays. Rows that repeat both stay or go together.
    """
    told = _told(docs, words, percent, text, identifier)
    lost = told.where("n > 0 AND (doc_id <> component_id OR text_key <> component_key)").select(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key")).distinct()
    mine = (docs[identifier].cast("bigint") == lost["lost_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == lost["lost_key"])
    return docs.join(lost, mine, "left_anti")


@register("op3_ngram_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
