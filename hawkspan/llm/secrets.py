"""Secrets in texts: fixed patterns, and a character convolutional network over every candidate and its surroundings.

The patterns' findings are always reported. Every other long token, whatever its letters, is a candidate. The network (numpy) reads a
window of characters around a candidate, with a mark on the candidate's own: embedding, convolution, rectifier, maximum over places,
logistic output. A candidate longer than a window is read by overlapping windows from its start to its end, and scores as its highest one;
in training each of them is an example with the candidate's label.

It is trained on labelled findings: values that the patterns find are secret, tokens of every shape and of eight characters up that they
do not find are harmless. A secret without a keyword has to be known by its value, so each value is shown twice, in its own place and in
the surroundings of a harmless token. Scores are calibrated on held-out values of the second sort, and the threshold is the highest that
keeps the wanted share of those (recall); so what is constrained is the recall of values that no pattern reports. Values too short to be
a candidate are learned, but have no say in the threshold unless there are no others.

``learn`` trains on every distinct value and token of all documents, each once, in one of its surroundings. They are dealt into shards by
hash; in each pass every shard trains from the weights so far, and the shards' weights are averaged. A third of the findings, by hash, is
held out, and all of it sets calibration and threshold. A finding's shard and surroundings do not depend on how documents are dealt out.

``train`` is for callers that want a bounded set in one process: of the values, and of the harmless tokens of each shape (which of small,
capital letter, digit and sign occur), those with the smallest hash, ``TRAIN_VALUES`` and ``TRAIN_TOKENS`` at most. The query does not use it.

Defined cases: a null text counts as empty and has no spans; with fewer than ``LEAST`` values or harmless tokens nothing can be learned,
and results say so (``trained`` is false), as when by hash all values are held out or none is; equal windows score alike; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hawkspan.llm.base import register, table
from hawkspan.session import stored

TRAIN_VALUES, TRAIN_TOKENS, LEAST = 3000, 300, 6  # values, harmless tokens of each of 15 shapes; at least of either
RECALL = 0.98
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
STRIDE = INSIDE // 2  # between the windows of a longer candidate
HELD = 8192  # windows that a task holds at once
DIMENSIONS, FILTERS, REACH = 8, 24, 5
SHARD, SHOWN = 1 << 16, 32  # findings that train together; of the rarer label at least, which is copied into more shards for that
TRIES = 4096  # secret windows that are judged for the threshold at least: few values are judged in more surroundings
KEPT = 100_000  # distinct findings that a task holds before it hands them on
RATES = (0.02, 0.01, 0.004)  # Adam's, by pass
FINE = 1000  # steps of a logit that are told apart in calibration and threshold

# The kinds of base findings, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more of [0-9a-f]+
KINDS = ("assign", "access", "hex", "opaque")

LONG = 16  # code points of a candidate at least
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LONG)
HARMLESS = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}")
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
ALPHABET_OF = np.isin(np.arange(128), ALPHABET)
SHAPES = [re.compile(x) for x in ("[a-z]", "[A-Z]", "[0-9]", "[+/_=-]")]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern findings."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def other_tokens(text: str, base: list[tuple[int, int, int]], pattern: re.Pattern = TOKEN) -> list[tuple[int, int, int]]:
    """Tokens beside the pattern findings."""
    found, at, reach = [], 0, 0
    for m in pattern.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= m.start():
            found.append((m.start(), 3, m.end()))
    return found


def values(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The secret part of each finding: the whole of it, but for keyword and sign."""
    return [(ASSIGN.match(text, s).start(2) if kind == 0 else s, e) for s, kind, e in base]


def shape(token: str) -> int:
    return sum(bool(p.search(token)) << i for i, p in enumerate(SHAPES))


def window(text: str, start: int, end: int) -> bytes:
    """Fixed width: characters before, the candidate (at most ``INSIDE``), characters after; then the mark. Others than printable ASCII are 0."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\x01")
    inside = text[start : min(end, start + INSIDE)]
    after = text[end : end + WIDTH - BEFORE - len(inside)].ljust(WIDTH - BEFORE - len(inside), "\x01")
    mark = b"\0" * BEFORE + b"\1" * len(inside) + b"\0" * (WIDTH - BEFORE - len(inside))
    return "".join(c if " " <= c <= "~" else "\0" for c in before + inside + after).encode("ascii") + mark


def windows_of(text: str, start: int, end: int) -> Iterator[bytes]:
    """The windows of a candidate: one, or overlapping ones that end with its end."""
    last = max(start, end - INSIDE)
    for at in range(start, last, STRIDE):
        yield window(text, at, min(end, at + INSIDE))
    yield window(text, last, end)


class Network:
    """The parameters are plain arrays: embedding, filters, their offsets, output weights; then calibration and threshold."""

    def __init__(self, weights: list[np.ndarray], calibration: tuple[float, float] = (1.0, 0.0), threshold: float = 0.5):
        self.weights, self.calibration, self.threshold = weights, calibration, threshold

    @staticmethod
    def fresh(seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        channels = DIMENSIONS + 1
        return Network([
            rng.normal(0, 0.3, (128, DIMENSIONS)).astype(np.float32), rng.normal(0, (2 / (channels * REACH)) ** 0.5, (REACH * channels, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32),
        ])

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        marked = np.concatenate([np.insert(self.weights[0], DIMENSIONS, mark, axis=1) for mark in (0, 1)])
        embedded = marked[windows[:, :WIDTH] + (windows[:, WIDTH:] << 7)]
        reaches = np.lib.stride_tricks.sliding_window_view(embedded.reshape(len(windows), -1), REACH * (DIMENSIONS + 1), axis=1)
        return np.ascontiguousarray(reaches[:, :: DIMENSIONS + 1])

    def forward(self, windows: np.ndarray):
        columns = self._columns(windows)
        maps = columns @ self.weights[1]
        places = maps.argmax(axis=1)
        # The rectifier keeps the order, so it comes after the maximum.
        pooled = np.maximum(np.take_along_axis(maps, places[:, None, :], 1)[:, 0] + self.weights[2], 0)
        return columns, places, pooled, pooled @ self.weights[3] + self.weights[4]

    def gradients(self, windows: np.ndarray, labels: np.ndarray, share: np.ndarray | float | None = None) -> list[np.ndarray]:
        columns, places, pooled, logits = self.forward(windows)
        slope = ((1 / (1 + np.exp(-logits)) - labels) * (1 / len(labels) if share is None else share)).astype(np.float32)
        into = slope[:, None] * self.weights[3] * (pooled > 0)
        rows = np.arange(len(windows))[:, None]
        seen = columns[rows, places]  # rows x filters x channels
        filters = np.einsum("nfc,nf->cf", seen, into)
        back = into[:, :, None] * self.weights[1].T[None]  # rows x filters x channels
        channels = DIMENSIONS + 1
        read = np.stack([windows[rows, places + i] for i in range(REACH)], axis=2).astype(np.intp)  # rows x filters x reach
        cells = read[..., None] * DIMENSIONS + np.arange(DIMENSIONS)
        into_cells = back.reshape(*read.shape, channels)[..., :DIMENSIONS]
        embedding = np.bincount(cells.ravel(), into_cells.ravel(), self.weights[0].size).reshape(self.weights[0].shape).astype(np.float32)
        return [embedding, filters, into.sum(axis=0), (pooled * slope[:, None]).sum(axis=0), slope.sum(keepdims=True)]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(windows))

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self.forward(windows[i : i + 256])[3] for i in range(0, len(windows), 256)]])

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))


class Adam:
    """Adam's moments for the weights of a network."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.step = net, rate, 0
        self.first, self.second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]

    def follow(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for w, g, m, v in zip(self.net.weights, gradients, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def calibrate(logits: np.ndarray, y: np.ndarray, times: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Logistic regression on the logits, by damped gradient steps; a logit may count several times."""
    a, b = 1.0, 0.0
    share = np.broadcast_to(times, logits.shape) / np.broadcast_to(times, logits.shape).sum()
    for _ in range(200):
        error = (1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30))) - y) * share
        a, b = a - 0.05 * ((error * logits).sum() + 1e-3 * (a - 1)), b - 0.05 * error.sum()
    return float(a), float(b)


def moved(positives: np.ndarray, negatives: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The values of ``positives`` in the surroundings of ``negatives``: what stands before and after comes from there."""
    hosts = negatives[rng.integers(len(negatives), size=len(positives))]
    inside, size = positives[:, WIDTH:].astype(bool), hosts[:, WIDTH:].sum(axis=1, dtype=int)[:, None]
    # What follows the host's token, over and over with an end between.
    behind = np.arange(WIDTH) - BEFORE - inside.sum(axis=1)[:, None]
    at = np.maximum(behind, 0) % (WIDTH - BEFORE - size + 1) + BEFORE + size
    after = np.where(at < WIDTH, np.take_along_axis(hosts, np.minimum(at, WIDTH - 1), 1), 1)
    text = np.where(inside, positives[:, :WIDTH], np.where(behind < 0, hosts[:, :WIDTH], after))
    return np.concatenate([text, positives[:, WIDTH:]], axis=1, dtype=np.uint8, casting="unsafe")


def varied(positives: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The values of ``positives``, cut at random to no less than a candidate's length; half of them drawn anew, in letters and digits.

    A value without a keyword may have another length and alphabet than the ones that the patterns know. What stands around is left out.
    """
    size = positives[:, WIDTH:].sum(axis=1, dtype=int)[:, None]
    kept = rng.integers(np.minimum(size, LONG), size + 1)
    begin = rng.integers(0, size - kept + 1)
    at = np.arange(WIDTH)
    inside = (at >= BEFORE) & (at < BEFORE + kept)
    text = np.take_along_axis(positives[:, :WIDTH], np.minimum(at + begin, WIDTH - 1), 1)
    anew = rng.integers(2, size=(len(positives), 1)).astype(bool) & ALPHABET_OF[text]
    text = np.where(anew, ALPHABET[rng.integers(len(ALPHABET), size=text.shape)], text)
    return np.concatenate([np.where(inside, text, 1), inside], axis=1, dtype=np.uint8, casting="unsafe")


def fit(positives: np.ndarray, negatives: np.ndarray, epochs: int = 6, seed: int = 5) -> Network | None:
    """Adam on two thirds of the findings; calibration and threshold on the rest, values in strange surroundings."""
    if len(positives) < LEAST or len(negatives) < LEAST:
        return None
    rng = np.random.default_rng(seed)
    held_p, held_n = np.arange(len(positives)) % 3 == 0, np.arange(len(negatives)) % 3 == 0
    secret, harmless = positives[~held_p], negatives[~held_n]
    shown = np.concatenate([secret, moved(secret, harmless, rng)])
    # Both labels weigh the same: the rarer one is repeated.
    times = max(1, len(harmless) // len(shown)), max(1, len(shown) // len(harmless))
    train_x = np.concatenate([*[shown] * times[0], *[harmless] * times[1]])
    train_y, net = np.repeat([1.0, 0.0], [len(shown) * times[0], len(harmless) * times[1]]), Network.fresh(seed)
    x = np.concatenate([moved(positives[held_p], negatives[held_n], rng), negatives[held_n]])
    y = np.repeat([1.0, 0.0], [held_p.sum(), held_n.sum()])
    adam = Adam(net, 0.01)
    for _ in range(epochs):
        order = rng.permutation(len(train_x))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            adam.follow(net.gradients(train_x[chosen], train_y[chosen]))
    net.calibration = calibrate(net.logits(x), y)
    right = np.sort(net.probabilities(x[y == 1]))
    net.threshold = float(right[int((1 - RECALL) * len(right))])
    return net


def _prepared(docs: DataFrame, text: str, identifier: str) -> DataFrame:
    return docs.select(docs[identifier].cast("bigint").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))


class Smallest:
    """The examples with the smallest hashes of one sort, each value once: what any task keeps holds the corpus's smallest."""

    def __init__(self, most: int):
        self.most, self.heap, self.seen = most, [], set()

    def wants(self, place: int) -> bool:
        return len(self.heap) < self.most or place < -self.heap[0]

    def add(self, place: int) -> None:
        if place not in self.seen:
            self.seen.add(place)
            heapq.heappush(self.heap, -place)
            if len(self.heap) > self.most:
                self.seen.discard(-heapq.heappop(self.heap))


def train(docs: DataFrame, text: str = "text", identifier: str = "doc_id", values_most: int = TRAIN_VALUES, tokens_most: int = TRAIN_TOKENS) -> Network | None:
    """Learn from the findings in all documents, in one scan; at most ``values_most`` and 15 times ``tokens_most`` examples reach the driver."""

    def findings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorts = {k: Smallest(values_most if k == 16 else tokens_most) for k in range(17)}  # 16: values, else by shape
        best: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            for text_ in batch["text"].to_pylist():
                base = base_spans(text_)
                examples = [(s, e, 16) for s, e in values(text_, base)] + [(s, e, -1) for s, _, e in other_tokens(text_, base, HARMLESS)]
                for s, e, sort in examples:
                    token = text_[s:e]
                    place = xxhash.xxh3_64_intdigest(token.encode()) >> 1
                    if sort < 0:
                        sort = shape(token)
                    if sorts[sort].wants(place) or (sort, place) in best:
                        sorts[sort].add(place)
                        views = list(windows_of(text_, s, e))
                        best[sort, place] = min(best.get((sort, place), views), views)
            if len(best) > 4 * (values_most + 15 * tokens_most):
                best = {k: v for k, v in best.items() if k[1] in sorts[k[0]].seen}
        rows = [(k, place, views) for (k, place), views in best.items() if place in sorts[k].seen]
        for at in range(0, len(rows), 1000):
            sort, place, views = zip(*rows[at : at + 1000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(sort, pa.int32()), pa.array(place, pa.int64()), pa.array(views, pa.list_(pa.binary()))], ["sort", "place", "windows"])

    found = _prepared(docs, text, identifier).select("text").mapInArrow(findings, "sort int, place bigint, windows array<binary>")
    # Of several surroundings of one value the smallest counts, as within a task.
    once = found.groupBy("sort", "place").agg(F.min("windows").alias("windows"))
    ranked = once.withColumn("at", F.row_number().over(Window.partitionBy("sort").orderBy("place"))).where(F.col("at") <= max(values_most, tokens_most))
    picked = ranked.where(F.col("at") <= F.when(F.col("sort") == 16, values_most).otherwise(tokens_most)).orderBy("sort", "place").collect()
    sides = [[bytes(w) for r in picked if (r.sort == 16) == side for w in r.windows] for side in (True, False)]
    return fit(*[np.frombuffer(b"".join(s), np.uint8).reshape(-1, 2 * WIDTH) for s in sides])


def _findings(docs: DataFrame, text: str, identifier: str) -> DataFrame:
    """secret, place (hash of the value), passage (``BEFORE`` characters, the value, what follows) and size of the value.

    Each distinct value of either label once, in that of its passages with the smallest hash.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[bool, str], tuple[int, str]] = {}

        def rows() -> pa.RecordBatch:
            secret = [secret for secret, _ in best]
            place = [xxhash.xxh3_64_intdigest(token.encode()) >> 1 for _, token in best]
            # One number for hash and size: the smallest hash is first.
            first = [mix << 32 | len(token) for (_, token), (mix, _) in best.items()]
            passage = [passage for _, passage in best.values()]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(secret, pa.bool_()), pa.array(place, pa.int64()), pa.array(first, pa.int64()), pa.array(passage, pa.string())], ["secret", "place", "first", "passage"])

        for batch in batches:
            for text_ in batch["text"].to_pylist():
                base = base_spans(text_)
                spans = [(True, s, e) for s, e in values(text_, base)] + [(False, s, e) for s, _, e in other_tokens(text_, base, HARMLESS)]
                for secret, s, e in spans:
                    # All that its windows show, and no more.
                    passage = text_[max(0, s - BEFORE) : max(s + WIDTH - BEFORE, e + AFTER)]
                    if s < BEFORE:
                        passage = "\x01" * (BEFORE - s) + passage
                    key, entry = (secret, text_[s:e]), (xxhash.xxh32_intdigest(passage.encode()) >> 1, passage)
                    if key not in best or entry < best[key]:
                        best[key] = entry
                if len(best) >= KEPT:
                    yield rows()
        yield rows()

    found = _prepared(docs, text, identifier).select("text").mapInArrow(scan, "secret boolean, place bigint, first bigint, passage string")
    once = found.groupBy("secret", "place").agg(F.min(F.struct("first", "passage")).alias("best"))
    return once.select("secret", "place", "best.passage", (F.col("best.first").bitwiseAND(0xFFFFFFFF)).cast("int").alias("size"))


SORTS = ("secret", "harmless", "held_secret", "held_short", "held_harmless")


def _shards(findings: DataFrame, shards: int, copies: dict[bool, int]) -> DataFrame:
    """A row per shard: its windows by label, those for training and the held-out third. ``copies``: into how many shards a finding of a label goes."""

    def pack(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*[group[c].to_pylist() for c in ("secret", "place", "passage", "size")], strict=True))
        sorts: dict[str, list[bytes]] = {name: [] for name in SORTS}
        for secret, place, passage, size in rows:
            if place % 3:
                name = "secret" if secret else "harmless"
            elif not secret:
                name = "held_harmless"
            else:
                name = "held_secret" if TOKEN.fullmatch(passage[BEFORE : BEFORE + size]) else "held_short"
            sorts[name] += [w[:WIDTH] + bytes([sum(w[WIDTH:])]) for w in windows_of(passage, BEFORE, BEFORE + size)]
        return pa.table({"shard": group["shard"][:1], **{name: pa.array([b"".join(w)], pa.binary()) for name, w in sorts.items()}})

    many = F.when(F.col("secret"), copies[True]).otherwise(copies[False])
    which = F.explode(F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.pmod(F.xxhash64("place") + i, F.lit(shards)).cast("int")))
    dealt = findings.withColumn("shard", which).repartition(shards, "shard")
    return dealt.groupBy("shard").applyInArrow(pack, "shard int, " + ", ".join(f"{name} binary" for name in SORTS))


def unpacked(windows: bytes) -> np.ndarray:
    """The windows of a shard's column, with their marks."""
    rows = np.frombuffer(windows, np.uint8).reshape(-1, WIDTH + 1)
    at = np.arange(WIDTH)
    return np.concatenate([rows[:, :WIDTH], ((at >= BEFORE) & (at < BEFORE + rows[:, WIDTH:].astype(int))).astype(np.uint8)], axis=1)


def one_pass(net: Network, secret: np.ndarray, harmless: np.ndarray, rate: float, seed: tuple[int, ...]) -> None:
    """Every window of a shard, in random order; both labels weigh the same. The rarer one is repeated, at a third of the other at least.

    Of either label a quarter of a batch is shown in its own place, the rest in strange surroundings (secret windows varied), so that the
    surroundings of a token do not decide alone.
    """
    rng, adam = np.random.default_rng(seed), Adam(net, rate)
    rounds = max(1, -(-len(harmless) // 96), -(-2 * len(secret) // 96))

    def parts(rows: np.ndarray, least: int) -> list[np.ndarray]:
        """For each round some rows: each of ``rows`` at least once."""
        n = max(len(rows), least * rounds)
        order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-n // len(rows)))])[:n]
        return [rows[x] for x in np.array_split(order, rounds)]

    for own, strange, plain in zip(parts(secret, 8), parts(secret, 24), parts(harmless, 32), strict=True):
        stay = -(-len(plain) // 4)
        windows = np.concatenate([own, moved(varied(strange, rng), plain, rng), plain[:stay], moved(plain[stay:], plain, rng)])
        sides = len(own) + len(strange), len(plain)
        adam.follow(net.gradients(windows, np.repeat([1.0, 0.0], sides), np.repeat([0.5 / sides[0], 0.5 / sides[1]], sides)))


def learn(docs: DataFrame, text: str = "text", identifier: str = "doc_id") -> Network | None:
    """Learn from all findings in all documents. The driver gets sums over shards and counts by logit, whose size does not grow with the documents."""
    findings = stored(_findings(docs, text, identifier), "secrets-findings")
    counts = {True: 0, False: 0} | {r.secret: r["count"] for r in findings.groupBy("secret").count().collect()}
    if min(counts.values()) < LEAST:
        return None
    shards = -(-sum(counts.values()) // SHARD)
    copies = {label: min(shards, -(-shards * SHOWN // n)) for label, n in counts.items()}
    packed = stored(_shards(findings, shards, copies), "secrets-shards")
    context = docs.sparkSession.sparkContext
    net = Network.fresh()
    sizes = np.cumsum([w.size for w in net.weights])[:-1]
    for number, rate in enumerate(RATES):
        shared = context.broadcast(net.weights)

        def trained(batches: Iterable[pa.RecordBatch], number=number, rate=rate, shared=shared) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(sum(w.size for w in shared.value), np.int64), 0
            for batch in batches:
                for shard, secret, harmless in zip(*[batch[c].to_pylist() for c in ("shard", "secret", "harmless")], strict=True):
                    if secret and harmless:
                        own = Network([w.copy() for w in shared.value])
                        one_pass(own, unpacked(secret), unpacked(harmless), rate, (5, number, shard))
                        # Whole numbers: their sum is the same in any order.
                        total, n = total + np.rint(np.concatenate([w.ravel() for w in own.weights]).astype(float) * 2**30).astype(np.int64), n + 1
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(-1, len(total)), pa.int32()), "total": pa.array(np.append(n, total), pa.int64())})

        sums = packed.select("shard", "secret", "harmless").mapInArrow(trained, "at int, total bigint").groupBy("at").agg(F.sum("total").alias("total")).collect()
        n, *total = [r.total for r in sorted(sums, key=lambda r: r.at)]
        if not n:
            return None
        mean = (np.array(total, float) / n / 2**30).astype(np.float32)
        net = Network([part.reshape(w.shape) for part, w in zip(np.split(mean, sizes), net.weights, strict=True)])
    return _judged(net, packed, max(1, -(-TRIES // (counts[True] * copies[True]))))


def _judged(net: Network, packed: DataFrame, times: int) -> Network | None:
    """The network with calibration and threshold from all held-out findings of all shards, values in ``times`` strange surroundings each."""
    shared = packed.sparkSession.sparkContext.broadcast(net.weights)

    def logits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Network(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                plain, rng = unpacked(row["held_harmless"]), np.random.default_rng((7, row["shard"]))
                if not len(plain):
                    plain = unpacked(row["harmless"])
                for label, name in enumerate(("held_harmless", "held_short", "held_secret")):
                    windows = unpacked(row[name])
                    if label and len(plain):
                        windows = moved(np.repeat(windows, times, axis=0), plain, rng)
                    found = np.clip(known.logits(windows), -30, 30)
                    steps, n = np.unique(np.floor(found * FINE).astype(np.int32), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(n), pa.int32()), "step": pa.array(steps, pa.int32()), "n": pa.array(n, pa.int64())})

    steps = packed.drop("secret").mapInArrow(logits, "label int, step int, n bigint").groupBy("label", "step").agg(F.sum("n").alias("n"))
    rows = sorted((r.label, r.step, r.n) for r in steps.collect())  # 3 labels, 60 * FINE + 1 steps of a logit at most
    kind, step, n = np.array(rows, np.int64).reshape(-1, 3).T
    wanted = kind == (2 if (kind == 2).any() else 1)
    if not wanted.any() or not (kind == 0).any():
        return None
    low = step / FINE
    net.calibration = calibrate(low, np.minimum(kind, 1), n)
    reached = np.cumsum(n[wanted])
    net.threshold = float(net.calibrated(low[wanted][reached > int((1 - RECALL) * reached[-1])][:1])[0])
    return net


def _raise(scores: list[float], net: Network, windows: list[bytes], owners: list[int]) -> None:
    """Each score becomes the highest of its windows'."""
    for i, p in zip(owners, net.probabilities(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, 2 * WIDTH)).tolist(), strict=True):
        scores[i] = max(scores[i], p)


def find_secrets(docs: DataFrame, net: Network | None, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """doc_id, spans (array of start, order, end, kind, score) and trained. Base findings have the network's score too (null without one)."""
    shared = docs.sparkSession.sparkContext.broadcast(None if net is None else (net.weights, net.calibration, net.threshold))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("order", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared.value is None else Network(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found, scores, windows, owners = [], [], [], []
                for text_ in part["text"].to_pylist():
                    base = base_spans(text_)
                    spans = sorted(base + (other_tokens(text_, base) if known else []))
                    found.append(spans)
                    for s, _, e in spans if known else []:
                        scores.append(0.0)
                        for view in windows_of(text_, s, e):
                            windows.append(view)
                            owners.append(len(scores) - 1)
                            if len(windows) == HELD:
                                _raise(scores, known, windows, owners)
                                windows, owners = [], []
                if windows:
                    _raise(scores, known, windows, owners)
                scores, rows = iter(scores), []
                for spans in found:
                    scored = [(s, k, e, KINDS[k], next(scores) if known else None) for s, k, e in spans]
                    rows.append([dict(zip(("start", "order", "end", "kind", "score"), x, strict=True)) for x in scored if x[1] < 3 or x[4] >= known.threshold])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(rows, spans_type)], ["doc_id", "spans"])

    found = _prepared(docs, text, identifier).mapInArrow(scan, "doc_id bigint, spans array<struct<start:bigint,order:bigint,end:bigint,kind:string,score:double>>")
    return found.withColumn("trained", F.lit(net is not None))


@register("op9_secrets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, learn(docs))
    joined = {name: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",") for name, spans in (("base", F.filter("spans", lambda s: s["order"] < 3)), ("all", F.col("spans")))}
    counts = [F.size(F.filter("spans", _is(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(joined["base"], 256).alias("base_sha256"), joined["all"].alias("spans"), counts[3], "trained")


def _is(kind: str):
    return lambda span: span["kind"] == kind
