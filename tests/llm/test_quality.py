import re
from collections import Counter

from tracecheck.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    w = WORD.findall(t or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, dup, seen = (t or "").split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t or "")), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def test_measures_equal_brute_force(odd, sample, spark):
    more = spark.createDataFrame([(i, t) for i, t in sample], "doc_id long, text string")
    for docs in (odd.select("doc_id", "text"), more):
        for r in quality.rejected_base(quality.ledger(docs)).collect():
            want = brute(r.text)
            assert {k: r[k] for k in want} == want
            assert r.base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])


def test_all_columns_pass_and_clashing_names_do_not_matter(odd):
    led = quality.ledger(odd, prefix="__")
    assert led.columns[: len(odd.columns)] == odd.columns and led.count() == odd.count()
    plain = quality.apply_policy(quality.ledger(odd))  # columns of the same name are replaced
    assert plain.columns.count("n_words") == 1 and plain.where("n_words = -1").count() == 0 and plain.count() == odd.count()


def test_policies_and_ablations(spark):
    led = spark.createDataFrame([(0,), (1,), (3,), (4,), (4,), (64,)], "failed long")
    kept = [r.kept for r in quality.apply_policy(led, "base").collect()]
    assert kept == [True, False, False, True, True, True]
    by_rule = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in quality.ablation(led, "v1").collect()}
    assert by_rule["few_words"] == (2, 1, 3) and by_rule["symbols"] == (2, 2, 4) and by_rule["repeated_windows"] == (1, 0, 2)
    assert tuple(quality.summary(led).first())[:2] == (71, 0)


def test_clean_documents_are_kept(spark):
    import pyarrow.parquet as pq

    labels = dict(zip(*(pq.read_table("/root/testdata/sf0.01/labels.parquet").column(c).to_pylist() for c in ("doc_id", "quality")), strict=True))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.rejected_base(quality.apply_policy(quality.ledger(docs, keep=["doc_id"]))).collect()
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if labels.get(r.doc_id) == 0]
    assert good and all(r.kept for r in good)
    assert sum(r.kept for r in bad) <= 0.02 * len(bad)


def test_empty(none):
    assert quality.ledger(none, prefix="__").count() == 0
