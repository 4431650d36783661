import corpus_pipeline
from test_copies import jaccard_components

from hawkspan.llm import mixing


def test_stages_equal_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name == "language_id":
            kept = {d: t for d, t in kept.items() if t and any(c.isalpha() for c in t)}
        elif name == "exact_dedup":
            last = {t: d for d, t in sorted(kept.items())}
            kept = {d: t for t, d in last.items()}
        elif name == "ngram_join":
            label, _ = jaccard_components(kept, 5, 80)
            kept = {d: t for d, t in kept.items() if label[d] == d}
        elif name == "mixing":
            copies = {r.doc.doc_id: r.copies for r in mixing.mix(before).collect()}
            assert ids == sorted(d for d, n in copies.items() for _ in range(n)) and set(ids) <= set(kept)
        if i < 3:
            assert ids == sorted(kept), name
        if name != "byte_bpe":
            assert docs.columns == columns
    assert ids == sorted(d for d, n in copies.items() for _ in range(n))
    assert all(r.n_tokens > 0 for r in docs.collect())
