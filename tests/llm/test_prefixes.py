import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tracecheck.llm import prefixes

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The trie's nodes with dictionaries; rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        own[c].append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        children[path[:-1]] += bool(path)
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(m) - 1) * (len(path[-1][1].encode()) if path else 0)
    found = []
    for path, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(path))))
        found.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=lambda r: r[:2])


def run(df, **options):
    return sorted((tuple(r) for r in prefixes.prefix_trie(df, **options).collect()), key=lambda r: r[:2])


def made(seed, n=60):
    """Conversations with shared starts, copies, gaps, ties, nulls and long tails."""
    rng = random.Random(seed)
    starts = [[("user", "hi"), ("assistant", "é" * k)] * 3 for k in range(3)]
    rows = []
    for c in range(n):
        turns = (rng.choice(starts)[: rng.randrange(7)] if rng.random() < 0.8 else []) + [(rng.choice(["user", None]), rng.choice(["x", "y", None, ""])) for _ in range(rng.choice([0, 1, 2, 3, 12]))]
        rows += [(c if rng.random() < 0.97 else None, rng.choice([k, k, None]) if k == 0 else k, *t) for k, t in enumerate(turns)]
    for c in range(200, 260):  # copies of a hot conversation, by five alike
        rows += [(c, k, "user", f"turn {k}") for k in range(12)]
    rows += [(10**12 + 3, 0, "user", "alone"), (-7, 0, "user", "hi"), (-7, 0, "user", "hi"), (-7, 0, "assistant", "a" * 5000)]
    return rows


@pytest.mark.parametrize("local", [prefixes.LOCAL, 0, 25])
def test_against_brute_force(spark, local):
    rows = made(local)
    assert run(spark.createDataFrame(rows, TURNS).repartition(5), local=local) == brute(rows)


def test_tails_with_batches_of_classes(monkeypatch):
    """Many classes at once, each of them as refined alone."""
    rng = np.random.default_rng(3)
    tops, conv, weight, first, key, n_bytes = [], [], [], [0], [], []
    for top in range(0, 400, 20):
        for c in range(top, top + int(rng.integers(1, 9))):
            n = int(rng.integers(1, 6))
            tops.append(top)
            conv.append(c)
            weight.append(int(rng.integers(1, 4)))
            key += [0, *rng.integers(0, 2, n - 1).tolist()]
            n_bytes += [1] * n
            first.append(first[-1] + n)
    a = [np.array(x) for x in (tops, np.ones(len(conv)), np.zeros(len(conv)), conv, weight, first, key, n_bytes)]
    whole = prefixes.refine(prefixes.Tails(*(x.astype(np.int64) for x in a)))
    rows = {tuple(int(whole[c][k]) for c in whole) for k in range(len(whole["conv_id"]))}
    apart = set()
    for top in set(tops):
        i = np.flatnonzero(np.array(tops) == top)
        lo, hi = first[i[0]], first[i[-1] + 1]
        part = prefixes.refine(prefixes.Tails(*(a[k][i].astype(np.int64) for k in range(5)), a[5][i[0] : i[-1] + 2].astype(np.int64) - lo, a[6][lo:hi].astype(np.int64), a[7][lo:hi].astype(np.int64)))
        apart |= {tuple(int(part[c][k]) for c in part) for k in range(len(part["conv_id"]))}
    assert rows == apart and len(rows) == len(whole["conv_id"])


def test_odd_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert run(empty) == []
    assert run(spark.createDataFrame([(None, 1, "user", "x")], TURNS)) == []
    rows = [(5, 1, "user", "x")]
    assert run(spark.createDataFrame(rows, TURNS)) == brute(rows)
    rows = [(5, None, None, None), (5, None, None, None), (5, 2, "user", "z" * 100_000), (6, 1, "user", "x")]
    clash = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], TURNS + ", pos int, key string, w int, n int")
    assert run(clash) == brute(rows)
