import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from strokewise.llm import decontaminate, jaccard, pii, quality  # noqa: E402
from strokewise.llm._tables import written  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}

    docs = written(corpus_pipeline.STAGES[0][1](spark, docs, sf_dir), "t")
    assert docs.columns == columns
    kept = {r.doc_id for r in docs.collect()}
    base = quality.brute_force([(d, r.text) for d, r in rows.items()])
    assert kept and not any(base[d][5] for d in kept)

    docs = written(corpus_pipeline.STAGES[1][1](spark, docs, sf_dir), "t")
    assert docs.columns == columns
    want = {c for _, c in jaccard.brute_force([(d, rows[d].text) for d in kept]).values()}
    kept = {r.doc_id for r in docs.collect()}
    assert kept == want

    docs = written(corpus_pipeline.STAGES[2][1](spark, docs, sf_dir), "t")
    assert docs.columns == columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = decontaminate.brute_force([(d, rows[d].text) for d in kept], items)
    kept = {d for d in kept if not hit[d][4]}
    assert {r.doc_id for r in docs.collect()} == kept

    docs = written(corpus_pipeline.STAGES[3][1](spark, docs, sf_dir), "t")
    assert docs.columns == columns
    for r in docs.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.candidates(rows[r.doc_id].text):
            assert r.text == rows[r.doc_id].text

    out = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in out} == kept
    whole = {}
    for r in out:
        whole[r.sequence_id] = whole.get(r.sequence_id, 0) + r.length
    assert max(whole.values()) <= 2048
