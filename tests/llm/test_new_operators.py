"""Spelling variants, fill-in-the-middle and repeated passages against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hawkspan.llm import fill_middle, phrases, variants

ODD_COLUMNS = "doc_id long, text string, word string, n string, output string, form string, key string, content string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, *["x"] * 6) for d, t in rows], ODD_COLUMNS)


def neighbours(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least=6, occurrences=5, spoil=199):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if spoil and h % spoil == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            count[word] += len(word) >= least
    words = {w: n for w, n in count.items() if n >= occurrences}
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if neighbours(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    result = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        result.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(result, key=str)


def read(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


@pytest.mark.parametrize(("cell", "block"), [(1000, 2000), (2, 3)])
def test_variants(spark, monkeypatch, cell, block):
    monkeypatch.setattr(variants, "CELL_WORDS", cell)
    monkeypatch.setattr(variants, "BLOCK_WORDS", block)
    rng = np.random.default_rng(4)
    base = ["harbour", "lantern", "Überfahrt", "voilà÷même", "anchors", "ANCHORS", "wwwwwwww", "tidetables"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(12):
            w = base[rng.integers(len(base))]
            if rng.random() < 0.3:
                at, kind = rng.integers(len(w)), rng.integers(3)
                w = w[:at] + ["", "e", w[at] + "e"][kind] + w[at + 1 :]
            words.append(w)
        rows.append((int(i) if i % 50 else None, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "short words only"), (1003, "x" * 50_000), *[(2000 + i, "y" * 3000 + " " + "y" * 2999) for i in range(6)], (7, rows[7][1]), (7, rows[7][1])]
    rows += [(3000 + i, " ".join([*["kelpbeds"] * 130, *["kelpbids"] * 26][i::13])) for i in range(13)] + [(3100 + i, "kalpbids") for i in range(5)]
    docs = table(spark, rows)
    got = read(variants.variants(variants.vocabulary_of(docs)))
    assert got == plain_variants(rows) and any(g[1] for g in got) and any(g[1] != g[2] for g in got if g[1])
    assert read(variants.variants(variants.vocabulary_of(docs.limit(0)))) == []


def test_all_pairs_of_blocks_are_met():
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abcé"), n)) for n in (6, 7, 8) for _ in range(150)})
    for x in (6, 7):
        for y in (x, x + 1):
            a, b = ([w for w in words if len(w) == k] for k in (x, y))
            i, j = variants.near_pairs(variants.letters(a), variants.letters(b), x == y)
            got = {(a[p], b[q]) for p, q in zip(i, j, strict=True)}
            assert got == {(v, w) for v in a for w in b if neighbours(v, w) and (x != y or v < w)}


def plain_form(doc_id, text, seed=1):
    sha = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", 500)
    rng = np.random.default_rng(9)
    letters = list("aé漢😀<PSM> \n")
    texts = [None, "", "a", "<P>", "x<S", "<M", "P>", "é漢字😀" * 2000, *("".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(400))]
    rows = [(i if i % 90 else None, t) for i, t in enumerate(texts)] + [(5, "again"), (5, "again")]
    made = fill_middle.restore(fill_middle.rearrange(table(spark, rows)))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made.collect()), key=str)
    assert got == sorted(((d, *plain_form(d, t), t or "") for d, t in rows), key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.rearrange(table(spark, rows[:0]))).count() == 0
    broken = spark.createDataFrame([("psm", "<S>a<P>b<M>c"), ("spm", "<S>a<P>b"), ("psm", "z<P>a<S>b<M>c"), ("other", "x"), ("plain", None), ("psm", "<P><S><M>")], "form string, output string")
    assert [r.restored for r in fill_middle.restore(broken.coalesce(1)).collect()] == [None] * 5 + [""]


def plain_repeats(rows, window):
    split = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [300, 8_000_000])
def test_repeats(spark, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "漢 字", "a b", "<|x|>"]

    def prose(n):
        return " ".join(rng.choice(vocabulary, n))

    passage, long = prose(33), prose(120)
    rows = [(i, prose(rng.integers(0, 90))) for i in range(60)]
    rows += [(100 + i, f"{prose(7)}\t{passage}\r\n {prose(9)}") for i in range(8)]
    rows += [(200 + i, " ".join(long.split()[10 * i : 10 * i + 60])) for i in range(7)]
    rows += [(300 + i % 3, rows[3][1] + " " + passage) for i in range(5)] + [(None, passage), (None, long), (-5, long), (400, None), (401, ""), (402, " \n"), (403, "one " * 3000), (404, "one " * 70), (405, "x" * 40_000)]
    rows += [(500 + i, long) for i in range(40)]
    got = phrases.remove_repeats(table(spark, rows), window=25).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got), key=str) == plain_repeats(rows, 25)
    assert phrases.remove_repeats(table(spark, rows[:0])).count() == 0
    with pytest.raises(ValueError):
        phrases.remove_repeats(table(spark, rows), window=12)


def test_chosen_phrases_are_the_same_in_equal_windows():
    rng = np.random.default_rng(0)
    line = rng.integers(0, 50, 400).astype(np.uint64)
    for width in (1, 2, 7, 41):
        got = set(phrases.chosen(line, width).tolist())
        want = set()
        for i in range(len(line) - width + 1):
            part = line[i : i + width]
            want |= {i + int(k) for k in np.flatnonzero(part == part.min())}
        assert got == want


def test_rolling_hashes_do_not_depend_on_the_place():
    words = [b"a", b"b", b"c", b"a", b"b", b"c", b"a"]
    runs = phrases.Rolling(phrases.ODD[0]).runs(phrases.word_hashes(words * 50, phrases.Digests())[:, 0], 5)
    assert len(set(runs.tolist())) == 7 and runs[0] == runs[7]
