import hashlib
import random

import duckdb
import numpy as np
import pytest

from tracecheck.llm import queries, suffix


def brute(docs):
    """docs: (id, text) rows; matches by sets of strings."""
    owner = {}
    for i, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            owner[w] = min(owner.get(w, 1 << 63), (1 << 63) - 1 if i is None else i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if owner[b[s : s + 50]] < ((1 << 63) - 1 if i is None else i):
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(r.randint(10, 40)) for _ in range(6)]
    docs = []
    for i in range(n):
        t = text(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randint(0, len(p))
            t += p[cut:] if r.random() < 0.5 else p[: cut + 30]
            t += text(r.randint(0, 10))
        docs.append((i, t))
    for i in range(n, n + 15):
        t = r.choice(docs)[1]
        at = r.randint(0, len(t))
        docs.append((i, t[:at] + r.choice(["", "x", "yy"]) + t[at + r.randint(0, 2) :]))
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs = made(seed)
    assert rows(suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_runs_ties_and_repeated_rows(spark):
    a = "a" * 120
    docs = [(3, a), (1, "a" * 70), (2, "b" * 49), (5, "b" * 49), (4, a + "c"), (4, a + "c"), (None, a), (None, a), (7, None), (8, ""), (9, "ab" * 60), (10, "ab" * 25), (11, "x" * 30 + "ab" * 40)]
    got = rows(suffix.remove_repeats(spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n_bytes string")))
    assert got == brute(docs)


def test_odd_rows(spark, odd, none):
    texts = odd.select("doc_id", "text").collect()
    assert rows(suffix.remove_repeats(odd)) == brute([(r.doc_id, r.text) for r in texts])
    assert suffix.remove_repeats(none).count() == 0


def test_what_is_left(spark):
    docs = [(1, "p" * 10 + "the passage " * 6), (2, "zz" + "the passage " * 6 + "end")]
    left = {r.doc_id: r.kept.decode() for r in suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), with_text=True).collect()}
    assert left[1] == docs[0][1] and left[2] == "zzend"


def test_every_string_has_an_anchor_that_depends_on_it_alone():
    r = random.Random(6)
    data = bytes(r.choice(b"abc ") for _ in range(3000))
    at, key = suffix.anchors(np.frombuffer(data, np.uint8), np.array([0, 1000, 1000, 1040, 3000]))
    places = set(at.tolist())
    for a, b in ((0, 1000), (1040, 3000)):
        for s in range(a, b - 49):
            own = [p - s for p in range(s, s + 31) if p in places]
            assert own
    assert not any(1000 <= p < 1040 for p in places)
    assert len(places) < 3000 / 10


def test_packing():
    arrays = [np.array([1, 5, 2**40], np.uint64), np.zeros(0, np.int32), np.arange(7, dtype=np.uint8)]
    back = suffix.unpack(suffix.pack(*arrays))
    assert all(x.dtype == y.dtype and (x == y).all() for x, y in zip(arrays, back, strict=True))


def test_suffix_buckets_are_equal_strings():
    r = np.random.default_rng(1)
    rows_ = r.integers(97, 99, (50, suffix.WIDTH + 2)).astype(np.uint8)
    rows_[10:20] = rows_[0:10]
    rows_[10:20, :5] = 120
    buckets = suffix.suffix_buckets(rows_)
    seen = {}
    for u in range(50):
        for o in range(suffix.LEFT + 1):
            seen.setdefault(bytes(rows_[u, o : o + 50]), set()).add(int(buckets[u, o]))
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_homes_are_sparks(spark):
    ids = [0, 1, -5, 2**40 + 3, (1 << 62) + 9]
    got = [r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("pmod(xxhash64(i), 37) as h").collect()]
    assert suffix.home_of(np.array(ids), 37).tolist() == got


def test_buckets_of_equal_strings():
    """Pointers are equal exactly where the MATCH bytes are, also where they only differ at the end or start."""
    r = np.random.default_rng(4)
    base = r.integers(97, 100, suffix.WIDTH + 2).astype(np.uint8)
    rows = [base]
    for k in range(300):
        row = rows[r.integers(0, len(rows))].copy()
        for at in r.integers(0, suffix.WIDTH, k % 4):
            row[at] = r.integers(97, 100)
        rows.append(row if k % 5 else np.roll(row, int(r.integers(1, 4))))
    rows = np.array(rows)
    found = suffix.suffix_buckets(rows)
    number, same = {}, {}
    for i, row in enumerate(rows):
        for o in range(suffix.LEFT + 1):
            text = row[o : o + suffix.MATCH].tobytes()
            assert same.setdefault(text, int(found[i, o])) == found[i, o]
            assert number.setdefault(int(found[i, o]), text) == text


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{sf}/documents.parquet')")
    got = queries.op5_suffix_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.ORACLES["op5_suffix_dedup"]).fetchall())
