import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from tracecheck.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_documents(spark, sample):
    docs = spark.createDataFrame(sample, "doc_id long, text string")
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).withColumn("hex", simhash.hex_fingerprint("fp")).collect()}
    fps = {i: brute_fingerprint(t) for i, t in sample}
    assert {i: int(r.hex, 16) for i, r in found.items()} == fps
    assert {i: r.component_id for i, r in found.items()} == brute_components(fps)


def test_chains_and_large_groups(spark):
    """Chains of links, and many fingerprints around one, over several tiles."""
    r = random.Random(3)
    fps = {}
    centre = r.getrandbits(64)
    for k in range(2200):
        fps[10_000 + k] = centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
    x = r.getrandbits(64)
    for k in range(60):
        fps[20_000 - k] = x
        x ^= 1 << r.randrange(64)
        x ^= 1 << r.randrange(64)
    for k in range(300):
        fps[k] = r.getrandbits(64)
    least = defaultdict(lambda: 1 << 60)
    for i, f in fps.items():
        least[f] = min(least[f], i)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for f, i in least.items()], "fp long, node long")
    got = dict((a.node, a.root) for a in simhash.components(simhash.links(nodes)).collect())
    want = brute_components({i: f for f, i in least.items()})
    assert {i: got.get(i, i) for i in want} == want


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.fp, r.component_id))
    assert {x[0] for i in (1, 2, 3) for x in by[i]} == {0} and {x[1] for i in (1, 2, 3) for x in by[i]} == {1}
    assert {x[1] for i in (4, 5, 6) for x in by[i]} == {4}
    assert simhash.near_duplicates(none).count() == 0


def test_radius_by_quarter_counts_loses_nothing():
    steps = set(simhash.neighbour_steps(2))
    r = random.Random(1)
    for _ in range(2000):
        a = r.getrandbits(64)
        b = a ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        ca, cb = (simhash.quarter_counts(np.array([v], np.uint64))[0] for v in (a, b))
        d = tuple((int(cb) >> 8 * i & 255) - (int(ca) >> 8 * i & 255) for i in range(4))
        assert d in steps or tuple(-x for x in d) in steps


def test_forest_connects_what_links_connect():
    r = random.Random(6)
    for n, m in ((40, 50), (1, 300), (200, 1)):
        centre = r.getrandbits(64)
        a, b = (np.array([centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) if r.random() < 0.7 else r.getrandbits(64) for _ in range(k)], np.uint64) for k in (n, m))
        linked = np.argwhere(np.bitwise_count(a[:, None] ^ b[None, :]) <= 2)
        want, got = (list(range(n + m)) for _ in range(2))

        def join(label, x, y):
            label[:] = [min(label[x], label[y]) if v in (label[x], label[y]) else v for v in label]

        for i, j in linked.tolist():
            join(want, i, j + n)
        for i, j in zip(*(x.tolist() for x in simhash.forest(a, b, 2)), strict=True):
            join(got, i, j)
        assert got == want


def jaccard(a, b):
    a, b = (set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return len(a & b) / max(1, len(a | b))


def copies(seed, groups, most):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(2000)]
    docs = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.randint(60, 300))]
        for _ in range(r.randint(1, most)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            docs.append((len(docs), " ".join(w)))
    return docs


def test_similar_texts_are_linked(spark, monkeypatch):
    docs = copies(5, 40, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i: i for i, _ in docs}
    for i, t in docs:
        for j, u in docs[:i]:
            if jaccard(t, u) >= 0.8:
                a, b = sorted((want[i], want[j]))
                want = {k: (a if v == b else v) for k, v in want.items()}
    plain = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    for tile, sent in ((2048, 100_000), (2, 0)):  # also with many tiles a key, and texts joined by a shuffle
        monkeypatch.setattr(simhash, "TILE", tile)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, similar=simhash.Similar(sent=sent)).collect()}
        assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
        assert all(got[i] <= plain[i] for i in got)
        by = defaultdict(list)
        for i, c in got.items():
            by[c].append(i)
        assert all(max(jaccard(docs[i][1], docs[k][1]) for k in g if k != i) >= 0.8 or len({plain[k] for k in g}) == 1 for g in by.values() if len(g) > 1 for i in g)


def test_similar_with_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd, similar=simhash.Similar()).collect()
    assert len(rows) == odd.count() and simhash.near_duplicates(none, similar=simhash.Similar()).count() == 0


def test_similar_texts_with_far_or_equal_fingerprints(spark):
    """Repeated sentences and appended words move the fingerprint; texts of one fingerprint may differ."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    docs = []
    for k in range(30):
        base, more = [word() for _ in range(200)], [word() for _ in range(10)]
        base[50:60] = more
        docs.append((2 * k, " ".join(base)))
        docs.append((2 * k + 1, " ".join(base + more * 10)))
    far = 0
    for k in range(30):
        a, b = (simhash.fingerprint(simhash.shingle_hashes(docs[2 * k + x][1].encode())) for x in (0, 1))
        far += bin(a ^ b).count("1") > 16
        assert jaccard(docs[2 * k][1], docs[2 * k + 1][1]) >= 0.8
    assert far > 5
    # One fingerprint (of the repeated words) and different ends; 91 is near 90 only.
    hot, end = [word() for _ in range(3)] * 200, [word() for _ in range(60)]
    docs += [(80, " ".join(hot)), (90, " ".join(hot + end)), (91, " ".join(hot[:9] + end))]
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), similar=simhash.Similar()).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(30))
    a, b, c = (simhash.fingerprint(simhash.shingle_hashes(t.encode())) for _, t in docs[-3:])
    assert a == b != c and bin(a ^ c).count("1") > 2 and jaccard(docs[-2][1], docs[-1][1]) >= 0.8
    assert got[90] == got[91] == 80


def test_no_candidate_is_left_uncompared(spark):
    """Pages of one template (similarity 0.7): many are nearer by chance than the one that is a near duplicate."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    template, docs = [word() for _ in range(200)], []
    for k in range(60):
        page = [word() for _ in range(32)] + template[32:]
        docs += [(2 * k, " ".join(page)), (2 * k + 1, " ".join(page[:184] + [word() for _ in range(16)]))]
    for a, b, least in ((0, 1, True), (0, 2, False), (1, 2, False), (1, 3, False)):
        assert (jaccard(docs[a][1], docs[b][1]) >= 0.8) == least
    df = spark.createDataFrame(r.sample(docs, len(docs)), "doc_id long, text string")
    for similar in (simhash.Similar(), simhash.Similar(bits=64)):  # with 64 bits, maps hardly tell texts apart
        got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df, similar=similar).collect()}
        plain = {x.doc_id: x.component_id for x in simhash.near_duplicates(df).collect()}
        assert len(set(plain.values())) > 100
        assert all(got[2 * k] == got[2 * k + 1] for k in range(60))


def test_repeated_ids_lose_no_link(spark):
    """Twelve ids with two texts each, both near another document's, in any row order."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    rows, want = [], {}
    for k in range(12):
        a, b = ([word() for _ in range(120)] for _ in range(2))
        near_a, near_b = a[:114] + [word() for _ in range(6)], [word() for _ in range(5)] + b[5:]
        rows += [(100 + k, " ".join(a)), (100 + k, " ".join(b)), (200 + k, " ".join(near_a)), (50 + k, " ".join(near_b))]
        want |= {100 + k: 50 + k, 200 + k: 50 + k, 50 + k: 50 + k}
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string").repartition(3)
        got = simhash.near_duplicates(df, similar=simhash.Similar()).collect()
        assert len(got) == 48 and {(x.doc_id, x.component_id) for x in got} == set(want.items())
    # Fingerprints alone: what either text of an id is linked to is linked.
    rows = [(5, "one two three four"), (5, "five six seven eight"), (7, "one two three four"), (3, "five six seven eight"), (9, "nine ten")]
    assert {(x.doc_id, x.component_id) for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(5, 3), (7, 3), (3, 3), (9, 9)}


def test_long_texts_are_told_apart():
    """Unrelated texts around one shared paragraph: few are candidates, at any length; near duplicates always are."""
    r = np.random.default_rng(8)
    similar, shared = simhash.Similar(), r.integers(0, 1 << 63, 60).astype(np.uint64)
    for n in (300, 1000, 2500, 5000, 20_000):
        sets = [np.unique(np.concatenate([shared, r.integers(0, 1 << 63, int(n * f)).astype(np.uint64)])) for f in r.uniform(0.85, 1.15, 60)]
        for k in range(0, 20, 2):  # near duplicates in pairs, some of them with maps of different sizes
            sets[k + 1] = np.unique(np.concatenate([sets[k][: int(len(sets[k]) * 0.95)], r.integers(0, 1 << 63, int(n * 0.1)).astype(np.uint64)]))
        size = np.array([len(s) for s in sets])
        maps = [simhash.parity(s, simhash.map_bits(len(s), similar.bits)) for s in sets]
        pairs = set()
        for bits in {len(m) * 8 for m in maps} | {len(m) * 4 for m in maps if len(m) * 8 > similar.bits}:
            at = [k for k, m in enumerate(maps) if len(m) * 8 == bits or (len(m) * 4 == bits and 0.8 * size[k] <= bits)]
            tile = simhash.Tile.made(bits, np.array(at), np.array(at), size[at], [maps[k] for k in at])
            i, j, _ = simhash.closest(tile, simhash.Tile.of(tile.to_bytes(), bits), similar, 1000)
            pairs |= {tuple(sorted((at[x], at[y]))) for x, y in zip(i.tolist(), j.tolist(), strict=True)}
        near = {(k, k + 1) for k in range(0, 20, 2)}
        assert near <= pairs and len(pairs - near) <= 0.01 * 60 * 59 / 2


def test_long_near_duplicates(spark):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    head, docs = [word() for _ in range(40)], []
    for k, n in enumerate((950, 1000, 1900, 2020, 4000, 4090)):  # maps of as many bits as their partners', or half
        base = head + [word() for _ in range(n)]
        docs += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base[: int(n * 0.98)] + [word() for _ in range(int(n * 0.1))]))]
    for spread in (2048, 2):
        simhash.TILE, before = spread, simhash.TILE
        try:
            got = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), similar=simhash.Similar()).collect()}
        finally:
            simhash.TILE = before
        assert all(got[10 * k + 1] == 10 * k for k in range(6))
        assert len({got[10 * k] for k in range(6)}) == 6
