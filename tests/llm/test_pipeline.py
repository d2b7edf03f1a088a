import shutil

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken

from tracecheck.llm import bpe, decontam, pii, quality, simhash

from .test_simhash import brute_components, brute_fingerprint


def stage_ids(spark, docs, sf_dir, name):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)


def test_run_equals_brute_force(spark, tmp_path):
    for t in ("documents", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
    sf = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality.apply_policy(quality.ledger(docs, keep=["doc_id"])).where("kept").collect()}
    fps = {i: brute_fingerprint(texts[i]) for i in kept}
    groups = brute_components(fps)
    sets = {i: set(simhash.shingle_hashes((texts[i] or "").encode(), 5).tolist()) for i in kept}
    for i in sorted(kept):
        for j in kept:
            if j < i and groups[i] != groups[j] and len(sets[i] & sets[j]) >= 0.8 * max(1, len(sets[i] | sets[j])):
                a, b = sorted((groups[i], groups[j]))
                groups = {k: (a if v == b else v) for k, v in groups.items()}
    kept = {i for i, c in groups.items() if i == c}
    hits = {r.doc_id for r in decontam.overlaps(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    kept -= hits
    field = pii.train()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: enc.encode_ordinary(pii.mask(texts[i], pii.all_spans(texts[i], field)[1])) for i in kept}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()} == want


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "decontamination", "personal_data"])
def test_stages_keep_columns_and_take_odd_rows(spark, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (odd, none):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.schema.names == docs.schema.names
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = out.collect()
        assert len(rows) <= docs.count()
        assert all((r._rule_kept, r._masked, r.kept, r.fp, r.n_words) == (7, "m", "clash", "f", -1) for r in rows)


def test_near_duplicates_keep_one_of_each_group(spark, odd):
    left = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd, "").collect() if r.doc_id is not None]
    want = {r.component_id for r in simhash.near_duplicates(odd, similar=simhash.Similar()).where("doc_id is not null").collect()}
    assert sorted(left) == sorted(want)


def test_different_texts_of_one_id_stay(spark):
    """Rows of one id go together; equal ones once, whatever their order."""
    words = " ".join(f"v{i}" for i in range(80))
    rows = [(1, words, "a"), (1, words, "b"), (1, "quite another text", "c"), (2, words, "d"), (3, "quite another text", "e"), (4, "alone", "f"), (None, words, "g")]
    left = [{tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(x, "doc_id long, text string, other string"), "").collect()} for x in (rows, rows[::-1])]
    assert left[0] == left[1] and len(left[0]) == 4
    assert {(r[0], r[1]) for r in left[0]} == {(1, words), (1, "quite another text"), (4, "alone"), (None, words)}


def test_tokens_of_odd_rows(spark, odd, none):
    for docs in (odd, none):
        rows = corpus_pipeline.tokens(spark, docs, "").collect()
        assert len(rows) == docs.count() and all(len(r.ids) == r.n_tokens for r in rows)


def test_personal_data_is_masked(spark, odd):
    text = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.personal_data(spark, odd, "").collect()}
    assert text[11][0] == "mail me at <EMAIL> or <PHONE>, <IP>" and text[11][1] == len(text[11][0])
    assert text[1][0] == ""
