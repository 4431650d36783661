from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hawkspan.llm import exact_dedup, mixing, ngram_join


@pytest.fixture()
def written(spark, tmp_path):
    def write(rows, schema, name="docs"):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return write


SCHEMA = "doc_id bigint, text string, kept string, digest string, source string"
ROWS = [(1, "a", "x", "y", "s"), (2, "a", None, None, "s"), (2, "a", None, None, None), (None, "a", "x", "y", "t"), (3, None, "x", "y", "s"), (4, "", "x", "y", "s"), (5, "A", "x", "y", "s"), (6, "é" * 100_000, "x", "y", "s")]


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup_with_and_without_collisions(written, bits):
    docs = written([*ROWS, *[(100 + i, f"text {i % 40}", "x", "y", "s") for i in range(200)]], SCHEMA)
    got = exact_dedup.exact_dedup(docs, digest_bits=bits, bytes_per_trigger=2000).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    want = sorted((-1 if d is None else d, max(x for x in ids if x is not None), len(ids)) for ids in groups.values() for d in ids)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and len({r.text_sha256 for r in got}) == len(groups)
    assert sorted(r.text or "" for r in exact_dedup.keep_first(docs, digest_bits=bits).collect()) == sorted(groups)


@pytest.mark.parametrize("bits", [256, 8])
def test_later_calls_meet_what_came_before(written, tmp_path, bits):
    state = str(tmp_path / "state")
    calls = [
        [(1, "a", "", "", ""), (2, "b", "", "", ""), (None, "c", "", "", "")],
        [(7, "a", "", "", ""), (0, "b", "", "", ""), (8, "d", "", "", ""), (8, "d", "", "", "")],
        [],
        [(3, "a", "", "", ""), (9, "c", "", "", ""), *[(100 + i, f"text {i % 300}", "", "", "") for i in range(400)]],
        [(600 + i, f"text {i}", "", "", "") for i in range(0, 300, 2)],
    ]
    seen = defaultdict(list)
    for number, rows in enumerate(calls):
        got = exact_dedup.exact_dedup(written(rows, SCHEMA, f"call{number}"), state_dir=state, digest_bits=bits).collect()
        for doc_id, text, *_ in rows:
            seen[text].append(doc_id)
        want = sorted((str(d), str(max((x for x in seen[t] if x is not None), default=None)), len(seen[t])) for d, t, *_ in rows)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
        keepers = {t: max((x for x in ids if x is not None), default=None) for t, ids in seen.items()}
        assert sum(r.kept for r in got) == len({t for d, t, *_ in rows if d == keepers[t]})


def test_exact_dedup_of_an_empty_table(written):
    assert exact_dedup.exact_dedup(written([], SCHEMA, "none")).count() == 0


def jaccard_components(texts, words, percent):
    sets = {d: {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if (w := (t or "").encode().lower().split()) else set() for d, t in texts.items()}
    label = {d: d for d in texts}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    return label, {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize(("words", "percent", "few", "frequent"), [(4, 85, 32, 4), (3, 60, 2, 0.01)])
def test_join_equals_brute_force(written, monkeypatch, words, percent, few, frequent):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rng = np.random.default_rng(3)
    texts = {0: None, 1: "", 2: "  ", 3: "One two", 4: "one TWO", 5: "one", 6: "É é one two three", 7: "é É one two three"}
    base = [f"w{i}" for i in rng.integers(0, 500, 80)]
    for d in range(10, 70):  # one large group of near copies
        words_ = list(base)
        for at in rng.integers(0, 80, rng.integers(0, 5)):
            words_[at] = f"new{rng.integers(0, 10**6)}"
        texts[d] = " ".join(words_)
    for d in range(70, 100):  # a shared passage in documents of their own
        texts[d] = " ".join([*base[:30], *(f"v{i}" for i in rng.integers(0, 10**6, rng.integers(5, 60)))])
    docs = written([(d, t, "k", "d", "s") for d, t in texts.items()] + [(None, "one two", "k", "d", "s")], SCHEMA)
    got = ngram_join.ngram_join(docs, words, percent).collect()
    label, sizes = jaccard_components(texts, words, percent)
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got if r.doc_id is not None} == {d: (label[d], sizes[d]) for d in texts}
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_join_of_a_document_in_the_first_slot(written):
    base = [f"w{i}" for i in range(80)]
    first = 25317696  # pmod(xxhash64(doc_id), 2^23) = 0
    docs = written([(first, " ".join(base), "k", "d", "s"), (first + 1, " ".join([*base, "more"]), "k", "d", "s"), (first + 2, "apart", "k", "d", "s")], SCHEMA)
    assert docs.selectExpr("pmod(xxhash64(doc_id), 8388608) AS slot").where("slot = 0").count() == 1
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()}
    assert got == {first: first, first + 1: first, first + 2: first + 2}


def test_keep_one_decides_texts_of_one_identifier_apart(written):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (5, c), (5, c + " more"), (6, None), (7, ""), (None, a)]
    got = [(r.doc_id, r.text) for r in ngram_join.keep_one(written([(d, t, "k", "d", "s") for d, t in rows], SCHEMA)).collect()]
    assert sum(d == 5 for d, _ in got) == 1
    assert {x for x in got if x[0] != 5} == {(1, a), (2, b), (6, None), (7, ""), (None, a)} and len(got) == 6


def test_linked_sets_always_share_a_signature():
    rng = np.random.default_rng(1)
    for percent in (60, 80, 85, 95):
        levels = rng.choice([0, 1, 5, ngram_join.LEVELS], 1 << ngram_join.BIN_BITS, p=[0.1, 0.1, 0.1, 0.7]).astype(np.uint8)
        for _ in range(300):
            x = np.unique(rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.uint64) * np.uint64(2))
            y = np.unique(np.concatenate([x[rng.random(len(x)) > (100 - percent) / 150], rng.integers(0, 2**63, rng.integers(0, 1 + len(x) // 12), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                assert len(np.intersect1d(ngram_join.signatures(x, levels, percent), ngram_join.signatures(y, levels, percent)))
                pair = [np.frombuffer(ngram_join.sketch(s), np.uint8) for s in (x, y)]
                assert ngram_join.possible(*pair, np.int64(len(x) + len(y)), percent)


def test_mixing_reaches_target_weights(written):
    rows = [(i, "word " * 20, "copies", "rate", "big" if i % 3 else "small") for i in range(3000)] + [(9000, None, None, None, "big"), (9001, "x", None, None, None), (9002, "x", None, None, "unlisted")]
    mixed = mixing.mix(written(rows, SCHEMA), {"big": 1.0, "small": 3.0, "": 0.0}).select("doc.*", "copy", "copies", "rate").toDF("doc_id", "text", "k1", "k2", "source", "copy", "copies", "rate").collect()
    share = sum(r.source == "small" for r in mixed) / len(mixed)
    assert abs(share - 0.75) < 0.03 and {r.source for r in mixed} == {"big", "small"}
    assert mixing.mix(written([], SCHEMA, "none")).count() == 0


def test_runs_of_parts_give_the_same_copies(written, monkeypatch):
    rows = [(i, "w" * (3000 if i % 9 else 2), "copies", "rate", "big" if i % 9 else "tiny") for i in range(60)] + [(9, "ww", "other", "row", "tiny"), (None, "ww", "", "", "tiny")]
    docs = written(rows, SCHEMA)

    def drawn():
        return sorted(map(str, mixing.mix(docs, {"big": 1.0, "tiny": 0.02}).select("doc.*", "copy", "copies", "rate", "shuffle_key").toDF("doc_id", "text", "k1", "k2", "source", "copy", "n", "rate", "key").collect()))

    want = drawn()
    monkeypatch.setattr(mixing, "RUN", 3)
    assert drawn() == want and sum("tiny" in x for x in want) > 900
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    assert drawn() == want


def test_a_source_of_two_characters_beside_millions(written):
    docs = written([(1, "ab", "", "", "tiny"), *[(i, "x" * 400_000, "", "", "big") for i in range(2, 7)]], SCHEMA)
    counts = {r["source"]: (r["n"], r["last"]) for r in mixing.mix(docs).groupBy("doc.source").agg(F.count("*").alias("n"), F.max("copy").alias("last")).collect()}
    assert abs(counts["tiny"][0] - 500_001) < 5_000 and counts["tiny"][0] == counts["tiny"][1]


def test_large_rates_do_not_underflow(written):
    rows = [(i, "ab", "", "", "rare") for i in range(5)] + [(100, "x" * 20_000, "", "", "common")]
    counts = mixing.mix(written(rows, SCHEMA), {"rare": 1.0}).groupBy("doc.doc_id").count().collect()
    assert len(counts) == 5 and all(abs(r["count"] - 2001) < 250 for r in counts)


def test_many_small_stores_hold_little_memory_and_are_closed_soon(spark, tmp_path):
    docs = [(i, f"text {i % 7}") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    rows = exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/docs")).collect()
    assert {r.doc_id for r in rows if r.kept} == set(range(33, 40)) and len(rows) == 40
    store = "spark.sql.streaming.stateStore."
    assert int(spark.conf.get(f"{store}rocksdb.maxMemoryUsageMB")) <= 64 and spark.conf.get(f"{store}rocksdb.writeBufferSizeMB") == "2" and spark.conf.get(f"{store}maintenanceInterval") == "10s"
