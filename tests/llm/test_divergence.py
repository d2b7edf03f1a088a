import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracecheck.llm import divergence


def brute(rows, least=10, ranks=10):
    """The audit with dictionaries; rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = []
    for lang in {r[1] for r in rows}:
        counts, docs = {}, Counter()
        for text, of, source in rows:
            if of == lang:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
                counts.setdefault(source, Counter()).update(terms)
                docs.update(set(terms))
        kept = sorted((t for t in docs if docs[t] >= least), key=str.encode)

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        own, whole = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(own[s][t], whole[t]), t) for t in kept if counts[s][t] and own[s][t] > whole[t]]
            for part, values, most in (("pair", pairs, None), ("term", terms, ranks)):
                for k, (v, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    found.append((lang, s, part, item, v, k + 1))
    return sorted(found)


def run(df, **options):
    return sorted(tuple(r) for r in divergence.divergence(df, **options).collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


@pytest.fixture(scope="module")
def made():
    """Texts with shared terms, odd letters, ties, nulls and a hot source."""
    rng = random.Random(5)
    words = ["alpha", "Alpine", "al", "be", "été", "éte", "漢字", "漢", "zz", "ZZ9zz", "🙂", "a" * 300, "a" * 299 + "b", "it's", "x_y"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "b", "c", None])) for _ in range(120)]
    return [*rows, *rows[:5], (None, "en", "only"), ("alpha", "xx", "lone"), ("", None, None), ("rare words here", "yy", "s"), ("rare", "yy", "t")]


def test_against_brute_force(spark, made):
    assert run(table(spark, made).repartition(7)) == brute(made)


def test_same_with_small_tries_and_deep_cuts(spark, made, monkeypatch):
    whole = run(table(spark, made))
    for name, value in (("LEAVES", 10), ("RANGE_BYTES", 200), ("CELLS", 8)):
        monkeypatch.setattr(divergence, name, value)
    # Workers import the module anew, so the parts are run here.
    tries = [divergence.count_terms(pa.array([(r[0] or "") for r in made[k::3]], pa.large_string()), np.zeros(len(made[k::3]), np.int64)) for k in range(3)]
    at_once = divergence.Trie.of(pa.concat_tables(tries))
    pieces = [(p, divergence.Trie.from_bytes(t.to_bytes())) for k in tries for p, t in divergence.Trie.of(k).cut(2)]
    deeper = [(p, t) for _, x in pieces for p, t in x.cut(64)]
    for cut in (pieces, deeper):
        terms, counts = [], []
        for prefix in sorted({p for p, _ in cut}):
            m = divergence.Trie.of(divergence.Trie.joined([t for p, t in cut if p == prefix]).counted())
            terms += m.terms()
            counts += m.count.tolist()
        assert terms == at_once.terms() == sorted(terms) and counts == at_once.count.tolist()
    assert run(table(spark, made).repartition(5)) == whole


def test_deep_cuts_in_spark(spark, made):
    own = table(spark, made).repartition(6).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    pieces = divergence.tries(own)
    before = divergence.RANGE_BYTES
    try:
        divergence.RANGE_BYTES = 300
        deep = divergence.cut_deeper(pieces)
    finally:
        divergence.RANGE_BYTES = before
    assert deep.agg(F.max(F.length("prefix"))).first()[0] > 200  # down to where the long terms part
    plain, cut = ({(r.lang, t, s) for r in divergence.merged(x).collect() for t in divergence.Trie.from_bytes(r.trie).terms() for s in r.sources} for x in (pieces, deep))
    assert {(lang, t) for lang, t, _ in cut} == {(lang, t) for lang, t, _ in plain}


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    of = [rng.randrange(2, 9 * 10**15) for _ in range(500)]
    counts = [rng.randrange(0, n - 1) for n in of]
    assert divergence.share(np.array(counts), np.array(of)).tolist() == [1 + 10**9 * (c + 2) // n for c, n in zip(counts, of, strict=True)]


def test_odd_rows(spark, odd, none):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert run(odd, least_docs=1) == brute(rows, least=1)
    assert run(odd.unionAll(odd)) == brute(rows + rows)
    assert run(none) == []
    assert divergence.divergence(none).columns == ["lang", "source", "part", "item", "value", "rank"]
