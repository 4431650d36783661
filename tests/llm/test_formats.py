import base64
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from hawkspan.llm import ann, byte_bpe, language_id, secrets, token_files, warc

TEXTS = [None, "", " ", "don't  stop\n\n x ", "é漢字😀 \x1c\x85 1٣Ⅷ²", "<|endoftext|> a", "ab " * 20_000, "a" * 5_000, "the cat. sat\non the mat, twice"]


def test_byte_bpe_equals_the_ranks_own_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {token: i for i, token in enumerate(byte_bpe.read_ranks(path))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in byte_bpe.encode_documents(docs, path).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == own.encode_ordinary(text or ""), i
        assert bytes(got[i].decoded) == (text or "").encode()
    assert byte_bpe.encode_documents(docs.limit(0), path).count() == 0


def test_token_shards_round_trip_and_single_documents(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = [(7 * i % 50, t) for i, t in enumerate(TEXTS)] + [(None, "x y"), (21, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_files.write_shards(docs, str(tmp_path / "shards"), token_files.tokenizer_encoder(path), shards=3)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(token_files.read_shards(manifest).collect(), key=lambda r: r.start)
    start = 0
    for (doc_id, text), r in zip(ordered, got, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shard = next(m.path for m in manifest.collect() if m.documents > 1)
    content = open(shard, "rb").read()
    reader = token_files.ShardReader(io.BytesIO(content))
    wanted = int(reader.ids[-1])
    assert len(reader.document(wanted)) >= 1 and reader.document(10**9) == []
    broken = bytearray(content)
    broken[int(reader.offsets[0]) + 8] ^= 255
    with pytest.raises(Exception):  # noqa: B017 - the unpacker or the checksum notices
        token_files.ShardReader(io.BytesIO(bytes(broken))).frame(0)
    assert token_files.read_shards(token_files.write_shards(docs.limit(0), str(tmp_path / "none"), token_files.tokenizer_encoder(path))).count() == 0


def test_token_files_equal_the_unchanged_library(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    literals = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n", "<|endoftext|", "<|ENDOFTEXT|> z"]
    rows = list(enumerate([*TEXTS, *literals, "after"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in token_files.op10(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    start = 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), doc_id
        start += len(ids)


def test_chunked_framing():
    for body in (b"", b"x", b"y" * 20_000):
        assert warc.unchunked(warc.chunked(body, 7)) == body
    assert warc.unchunked(b"3;q=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"0\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_pages_survive_segments_and_revisits(spark, tmp_path):
    rows = [(1, "u 1", "abc" * 500), (2, "u2", "abc" * 500), (3, None, None), (4, "u4", ""), (5, "u5", "é" * 3000), (0, "u0", "z")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages"))
    manifest = warc.write_archives(spark.read.parquet(str(tmp_path / "pages")), str(tmp_path / "warc"), segment_bytes=400)
    records = warc.read_archives(manifest)
    assert records.where("type = 'continuation'").count() > 5
    got = {r.page_id: r for r in warc.payloads(records).collect()}
    ids = {r.page_id: r.record_id for r in got.values()}
    for page_id, _, html in rows:
        payload, r = (html or "").encode(), got[page_id]
        assert (r.status, r.payload_bytes) == ("ok", len(payload))
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.refers_to == {2: ids[1], 4: ids[3]}.get(page_id)
        assert r.type == "revisit" or bytes(r.payload) == payload
    lost = records.where("NOT (type = 'continuation' AND number = 3)")
    assert {r.page_id: r.status for r in warc.payloads(lost).collect()}[5] == "incomplete"
    assert warc.payloads(warc.read_archives(manifest.limit(0))).count() == 0


def test_pages_through_the_query_with_null_and_repeated_identifiers(spark, tmp_path):
    rows = [(None, "n1", "same"), (None, "n2", "same"), (5, "u5", "x" * 9000), (5, "u5", "x" * 9000), (4, None, "x" * 9000), (None, None, None), (6, "u6", ""), (None, "n3", "only"), (7, "u7", "é" * 40_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.op5(spark, str(tmp_path)).collect())
    first, want = {}, []
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        kind, refers = ("revisit", first[payload]) if payload in first else ("response", None)
        first.setdefault(payload, page_id)
        want.append((str(page_id), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, str(refers)))
    assert got == sorted(want)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert warc.op5(spark, str(tmp_path / "none")).count() == 0


def test_the_query_splits_pages_of_the_given_tables(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    records = warc.read_archives(warc.write_archives(pages, str(tmp_path / "warc")))
    parts = records.where("type = 'continuation'").count()
    assert parts > pages.count() / 10
    assert {r.status for r in warc.payloads(records, content=False).select("status").distinct().collect()} == {"ok"}


@pytest.mark.parametrize("sets", [None, 4])
def test_neighbours_against_brute_force(spark, sets):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    odd = spark.createDataFrame([(10_000, None), (10_050, [0.0] * 64), (10_100, [float("nan")] + [1.0] * 63), (10_150, [1.0])], "vec_id long, embedding array<float>")
    index, centre, turn = ann.build_index(ann.valid_vectors(rows.select("vec_id", "embedding").unionByName(odd), "vec_id", "embedding"))
    got = {}
    for r in ann.search(index, centre, turn, F.col("vec_id") % 50 == 0, groups=3, sets=sets).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    data = rows.orderBy("vec_id").toPandas()
    ids, v = data.vec_id.to_numpy(), np.stack(data.embedding).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        scores = unit @ unit[q]
        scores[q] = -2
        best = ids[np.lexsort((ids, -np.round(scores, 12)))[:5]]
        mine = got[ids[q]]
        hit, total = hit + len(set(best) & {x[0] for x in mine.values()}), total + 5
        assert sorted(mine) == [1, 2, 3, 4, 5]
        assert all(abs(s - scores[np.searchsorted(ids, i)]) < 1e-9 for i, s in mine.values())
    assert hit / total >= 0.9 and set(got) == set(ids[ids % 50 == 0])


def test_language_on_held_out_documents(spark):
    rows = language_id.op8(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and {r.doc_id for r in held} == {d for d in truth if language_id.crc_remainder(d) == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_neighbours_of_few_equal_and_no_vectors(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0]), (2, [0.5, 0.0]), (50, [0.0, 1.0])]
    schema = "vec_id long, embedding array<float>, score string, code string"
    spark.createDataFrame([(i, v, "x", "y") for i, v in rows], schema).write.parquet(str(tmp_path / "few" / "embeddings.parquet"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.op4(spark, str(tmp_path / "few")).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (0, 4, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 2)]
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert ann.op4(spark, str(tmp_path / "none")).count() == 0


def plain_bayes(training, texts):
    """Counts in dictionaries, one text and one language at a time."""
    counts, documents = {}, {}
    for text, label in training:
        if text and label and any(c.isalpha() for c in text):
            buckets, n = language_id.bucket_counts(text)
            mine = counts.setdefault(label, {})
            for b, k in zip(buckets.tolist(), n.tolist(), strict=True):
                mine[b] = mine.get(b, 0) + k
            documents[label] = documents.get(label, 0) + 1
    result = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            result.append(("und", 0.0))
            continue
        logs = {}
        for label, mine in counts.items():
            whole = sum(mine.values()) + language_id.SMOOTHING * language_id.BUCKETS
            buckets, n = language_id.bucket_counts(text)
            logs[label] = np.log(documents[label] / sum(documents.values())) + sum(k * np.log((mine.get(b, 0) + language_id.SMOOTHING) / whole) for b, k in zip(buckets.tolist(), n.tolist(), strict=True))
        best = min(sorted(logs), key=lambda x: -logs[x])
        result.append((best, 1 / sum(np.exp(v - logs[best]) for v in logs.values())))
    return result


def test_language_against_plain_bayes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ENTRIES", 300)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").collect()
    training = [(r.text, r.lang) for r in rows[:120]] + [(None, "xx"), ("abc", None), ("...", "yy")]
    texts = [r.text[:500] for r in rows[120:]] + [None, "", "12", "ab", "ß" * 300_000]
    docs = spark.createDataFrame([(t, lab) for t, lab in training], "text string, lang string")
    asked = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    got = {r.doc.doc_id: (r.lang_pred, r.score) for r in language_id.predict(asked, language_id.train(docs)).collect()}
    for i, (name, value) in enumerate(plain_bayes(training, texts)):
        assert got[i][0] == name and abs(got[i][1] - value) < 1e-6, i
    assert language_id.predict(asked.limit(0), language_id.train(docs)).count() == 0


def test_rare_labels_fold_away(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    docs = spark.createDataFrame([(f"{label * 5} text", label) for i, label in enumerate("abcdefgh") for _ in range(9 - i)], "text string, lang string")
    assert language_id.train(docs).languages == ["a", "b", "c"]


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, "bonjour", "fr"), (2, "hello", "en"), (3, None, "en"), (4, "123 !", "fr"), (5, "x", None)], "doc_id long, text string, lang string")
    got = {r.doc.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert got[1][0] == "fr" and got[2][0] == "en" and got[3] == got[4] == ("und", 0.0)
    nothing = language_id.train(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_secrets_keep_base_findings_and_add_like_ones(spark):
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    texts = [f"set password: {''.join(rng.choice(letters, 24))} now" for _ in range(60)] + [f"see item-{i}-of-the-long-list-{i} there" for i in range(60)]
    texts += [None, "", "TOKEN='abc' secret = \"abcdef\"", "AKIA" + "A" * 16, "f" * 24, "f" * 23, "Kelvin to\u212aen=abcdefg", "é api_key:zzzzzz"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    net = secrets.train(docs)
    assert net is not None and 0 < net.threshold < 1
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs, net).collect()}
    for i, text in enumerate(texts):
        base = [(s.start, s.order, s.end) for s in got[i] if s.order < 3]
        assert base == secrets.base_spans(text or "")
    assert [len([s for s in got[i] if s.order < 3]) for i in range(120, 128)] == [0, 0, 1, 1, 1, 0, 0, 1]
    assert sum(any(s.order == 3 for s in got[i]) for i in range(60, 120)) <= 6
    assert secrets.train(docs.limit(0)) is None
    assert {r.trained for r in secrets.find_secrets(docs, None).collect()} == {False}


def plain_base_spans(text):
    """The base findings, found one character at a time."""
    lower, spans = "".join(c.lower() if c.isascii() else c for c in text), []
    word = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")

    def run(at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    def assignment(at):
        for key in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lower.startswith(key, at):
                i = at + len(key)
                i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
                i = run(i, " ")
                if text[i : i + 1] in (":", "=") and text[i : i + 1]:
                    i = run(i + 1, " ")
                    i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
                    end = run(i, word)
                    if end > i:
                        return end, end - i >= 6
        return None

    at = 0
    while at < len(text):
        hit = assignment(at)
        if hit and hit[1]:
            spans.append((at, 0, hit[0]))
        at = hit[0] if hit else at + 1
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        end = run(at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        if end >= at + 20:
            spans.append((at, 1, end))
        at = end if end > at + 4 else at + 1
    at = 0
    while at < len(text):
        end = run(at, set("0123456789abcdef"))
        if end - at >= 24:
            spans.append((at, 2, end))
        at = max(end, at + 1)
    return sorted(spans)


def test_secrets_of_the_query_against_plain_code_and_planted_ones(spark, tmp_path):
    rng = np.random.default_rng(11)
    tables = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    letters, mixed = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def draw(alphabet, n):
        return "".join(rng.choice(list(alphabet), n))

    keyless = [f"and then {draw(mixed, 30)} was left on the table" for _ in range(40)] + [f"see {draw('0123456789abcdef', 22)} again, she said" for _ in range(40)]
    harmless = [f"the word {draw(letters, 6)}{draw('aeiou', 1)}{draw(letters, 9)} is long" for _ in range(40)] + [f"number {draw('123456789', 16)} of the list" for _ in range(40)]
    odd = [None, "", "TOKEN='abc' secret = \"abcdef\"", "api_key: 'x' passwd=\u00e9 Password :  zzzzzz", "AKIAAKIA" + "B" * 15, "a" * 23 + "g" + "f" * 30, "to\u212aen=abcdefg secretsecret=abcdef.", "token=password=secret=abcdefgh"]
    texts = [*odd, *keyless, *harmless]
    rows = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tables.select("doc_id", "text").unionByName(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in secrets.op9(spark, str(tmp_path)).collect()}
    known = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    assert set(got) == set(known) and all(r.trained for r in got.values())
    for doc_id, text in known.items():
        want = plain_base_spans(text or "")
        r = got[doc_id]
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert [s for s in r.spans.split(",") if s and not s.startswith("opaque")] == (joined.split(",") if joined else [])
    first = 10**6 + len(odd)
    found = [got[first + i].n_opaque for i in range(len(keyless) + len(harmless))]
    assert sum(x > 0 for x in found[:80]) >= 60 and sum(x > 0 for x in found[80:]) <= 8
    assert sum(r.n_opaque > 0 for d, r in got.items() if d < 10**6) <= 50


def test_secrets_learn_from_every_finding_however_documents_are_dealt_out(spark, monkeypatch):
    """Findings beyond the bounds of ``train`` count, and the network is the same for any number of partitions and batches."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 12)) for _ in range(1500)]
    hidden = ["".join(rng.choice(list("0123456789abcdef"), 30)) for _ in range(60)]
    texts = [f"so {w} went on with {w[::-1]}, {w}" for w in words] + [f"the token={h} and {h} again" for h in hidden] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {(r.secret, r.passage[secrets.BEFORE : secrets.BEFORE + r.size]) for r in secrets._findings(docs, "text", "doc_id").collect()}
    assert found == {(False, w) for w in words} | {(False, w[::-1]) for w in words} | {(True, h) for h in hidden}

    monkeypatch.setattr(secrets, "SHARD", 600)
    monkeypatch.setattr(secrets, "RATES", (0.02, 0.01))
    seen = spark.sparkContext.accumulator(0)
    taught = secrets.one_pass

    def counted(net, secret, harmless, rate, seed):
        seen.add(len(harmless))
        taught(net, secret, harmless, rate, seed)

    monkeypatch.setattr(secrets, "one_pass", counted)
    first = secrets.learn(docs.repartition(5))
    held = sum((secrets.xxhash.xxh3_64_intdigest(w.encode()) >> 1) % 3 == 0 for v in words for w in {v, v[::-1]})
    assert seen.value == 2 * (3000 - held)  # 300 of a shape at most before
    monkeypatch.setattr(secrets, "KEPT", 7)
    second = secrets.learn(docs.coalesce(1))
    assert all((a == b).all() for a, b in zip(first.weights, second.weights, strict=True))
    assert (first.calibration, first.threshold) == (second.calibration, second.threshold)
    assert secrets.learn(docs.limit(0)) is None and secrets.learn(docs.where("doc_id < 1500")) is None


def test_secrets_threshold_is_from_all_held_out_values(spark):
    """The threshold is found by counting: the highest that keeps the wanted share of the values' windows in all shards."""
    net = secrets.Network([np.zeros_like(w) for w in secrets.Network.fresh().weights])
    net.weights[0][ord("Z"), 0] = net.weights[1][0, 0] = 1  # sees a Z and nothing else
    net.weights[3][0], net.weights[4][0] = 4, -1

    def windows(*values):
        return b"".join(w[: secrets.WIDTH] + bytes([sum(w[secrets.WIDTH :])]) for v in values for w in secrets.windows_of(v, 0, len(v)))

    def threshold(plain_values):
        rows = [(i, b"", windows(*["harmless"] * 5), windows(*["Z" * 16] * 48, *["a" * 16] * n), windows("short"), windows("harmless")) for i, n in enumerate(plain_values)]
        return secrets._judged(net, spark.createDataFrame(rows, "shard int, " + ", ".join(f"{c} binary" for c in secrets.SORTS)), 1)

    some = threshold([0, 1, 0])  # 1 of 145 may be missed, 4 of 148 not
    assert some.threshold == some.calibrated(np.array([3.0]))[0]
    more = threshold([0, 4, 0])
    assert more.threshold == more.calibrated(np.array([-1.0]))[0]

def test_training_examples_do_not_depend_on_the_partitions(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    monkeypatch.setattr(secrets, "fit", lambda positives, negatives: (positives.tobytes(), negatives.tobytes()))
    assert secrets.train(rows.repartition(7), values_most=20, tokens_most=5) == secrets.train(rows.coalesce(1), values_most=20, tokens_most=5)


def test_secrets_read_long_candidates_to_their_end(spark, monkeypatch):
    net = secrets.Network([np.zeros_like(w) for w in secrets.Network.fresh().weights])
    net.weights[0][ord("Z"), 0] = net.weights[1][0, 0] = 1  # sees a Z and nothing else
    net.weights[3][0], net.weights[4][0] = 10, -5
    plain = "part-0f-path/" * 9
    candidates = [plain, *(f"{plain[:at]}Z{plain[at + 1 :]}" for at in (0, 47, 48, 60, 90, len(plain) - 1)), "Z" + "a1" * 9, "b" + "a1" * 9]
    docs = spark.createDataFrame([(i, f"see {c} there") for i, c in enumerate(candidates)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secrets.find_secrets(docs, net).collect()}
    assert got == {i: [(4, 4 + len(c))] if "Z" in c else [] for i, c in enumerate(candidates)}
    monkeypatch.setattr(secrets, "HELD", 3)
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secrets.find_secrets(docs, net).collect()} == got
    monkeypatch.setattr(secrets, "fit", lambda positives, negatives: negatives)
    learned = secrets.train(docs)
    inside = [bytes(w[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE]).decode() for w in learned]
    for c in candidates:
        assert all(any(c[i : i + 24] in x for x in inside) for i in range(len(c) - 23)), c
