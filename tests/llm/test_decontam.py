import random

import pytest

from tracecheck.llm import decontam

R = random.Random(8)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(800)]
ITEMS = [" ".join(R.choice(WORDS) for _ in range(n)) for n in (30, 25, 40, 8, 60)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def tokens(t):
    return [x for x in ("".join(c for c in w.lower() if c.isalnum()) for w in (t or "").split()) if x]


def brute(text, item):
    """The best overlap over all diagonals."""
    a, b = tokens(text), tokens(item)
    best = 0
    for d in range(-len(b) + 1, len(a)):
        eq = [0 <= d + q < len(a) and a[d + q] == b[q] for q in range(len(b)) if 0 <= d + q < len(a)]
        run = score = top = 0
        for e in eq:
            score, run = (score + 1, run + 1) if e else (score - decontam.MISMATCH, run)
            if score <= 0:
                score = run = 0
            if score > top:
                top, best_run = score, run
        if top:
            best = max(best, best_run)
    return best >= min(decontam.MIN_MATCHED, max(1, -(-8 * len(b) // 10)))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([*enumerate(ITEMS), (None, None), (9, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def docs():
    rows = []
    for k in range(120):
        t = prose(R.randint(0, 120))
        if k % 3 == 0:
            w = ITEMS[k % 5].split()
            for _ in range(k % 4):  # some words are changed
                w[R.randrange(len(w))] = "changed"
            cut = w[: len(w) - (k % 5)]
            t = f"{t} {' '.join(cut).upper() if k % 2 else ' '.join(cut)}, {prose(20)}"
        rows.append((k, t))
    return rows


def test_overlaps_against_brute_force(spark, bench, docs):
    found = {(r.doc_id, r.item_id) for r in decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    want = {(i, n) for i, t in docs for n, item in enumerate(ITEMS) if brute(t, item)}
    assert found <= want  # all are verified
    assert len(found) >= 0.97 * len(want)
    exact = {(i, n) for i, t in docs for n, item in enumerate(ITEMS) if " ".join(tokens(item)) in " ".join(tokens(t))}
    assert exact <= found


def test_joined_gives_the_same_as_sent(spark, bench, docs, odd, none, monkeypatch):
    """A benchmark that is too large to be sent: its windows are joined to the texts' by a shuffle."""
    d = spark.createDataFrame([*docs, (None, docs[0][1]), (3, docs[3][1])], "doc_id long, text string")
    twice = bench.unionAll(bench.where("item_id < 3"))
    whole = sorted(map(str, decontam.overlaps(d, twice).collect()))
    one_by_one = {str(x) for k in (1, 2, 3, 4) for x in decontam.overlaps(d, bench.where(f"item_id = {k}")).collect()}
    assert one_by_one <= set(whole)
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 4)
    assert decontam.sent(decontam._named(bench, "item_id", "text")) is None
    assert sorted(map(str, decontam.overlaps(d, twice).collect())) == whole
    flagged = decontam.flag(d, twice, to="hit")
    assert {f"doc_id={r.doc_id}" for r in flagged.where("hit").collect()} == {x.split("(")[1].split(",")[0] for x in whole} and flagged.count() == d.count()
    for rows in (odd, none):
        assert decontam.overlaps(rows, bench).count() == 0 and decontam.flag(rows, bench, to="hit").columns == [*rows.columns, "hit"]


def test_many_items_joined_and_sent(spark, monkeypatch):
    """Fifty times as many items as one task was sent before, of all lengths."""
    items = [(k, prose(1 + k % 40)) for k in range(200)]
    rows = [(k, f"{prose(30)} {items[k * 7 % 200][1]} {prose(5)}") for k in range(100)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.overlaps(d, b).collect()))
    assert {(k, k * 7 % 200) for k in range(100)} <= {x[:2] for x in whole}
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 4)
    assert sorted(map(tuple, decontam.overlaps(d, b).collect())) == whole


def test_repeating_text_and_item():
    """Texts that repeat themselves share windows on nearly all diagonals."""
    import time

    import pyarrow as pa

    few = [f"w{k}" for k in range(7)]
    noisy = random.Random(4)
    texts = [" ".join(["again"] * 30_000), " ".join(few * 4000), " ".join(noisy.choice(few[:2]) for _ in range(3000)), " ".join(["again"] * 5 + ["x"]) * 3]
    items = [" ".join(["again"] * 1500), " ".join(few * 200), " ".join(noisy.choice(few[:2]) for _ in range(100)), " ".join(["again"] * 40)]
    block = decontam.Benchmark([0, 1, 2, 3], pa.array(items, pa.large_string()))
    hashes, first = decontam.tokens(pa.array(texts, pa.large_string()))
    began = time.perf_counter()
    found = {(t, i): (start, n, matched) for t, i, start, n, matched, _ in block.search(hashes, first)}
    assert time.perf_counter() - began < 5  # about 0.3 s on a quiet machine
    assert found[0, 0] == (0, 1500, 1500) and found[0, 3] == (0, 40, 40) and found[1, 1] == (0, 1400, 1400)
    doc, item = hashes[first[2] : first[3]], block.hashes[block.first[2] : block.first[3]]
    best = max((int(eq[a:b].sum()) for d in range(1 - len(item), len(doc)) for lo, hi in [(max(d, 0), min(d + len(item), len(doc)))] for eq in [doc[lo:hi] == item[lo - d : hi - d]] for a, b in decontam.runs(eq)))
    assert found[2, 2][2] == best >= 12


def test_odd_rows(spark, odd, none, bench):
    assert decontam.overlaps(odd, bench).count() == 0
    assert decontam.overlaps(none, bench).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.overlaps(odd, empty).count() == 0 and decontam.flag(odd, empty, to="hit").where("hit").count() == 0


def test_every_run_of_a_diagonal_counts(spark):
    item = [f"i{k}" for k in range(40)]
    texts = []
    for gap in (4, 3):
        w = list(item[: 11 + gap + 5 + 1 + 5 + 1 + 4])
        for k in (*range(11, 11 + gap), 16 + gap, 22 + gap):
            w[k] = "other"
        texts.append((gap, " ".join(w)))  # 11 equal, then 14 in a run of less score
    texts.append((9, " ".join([*item[:11], *["other"] * 29])))
    found = decontam.overlaps(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {(r.doc_id, r.start, r.n_tokens, r.n_matched) for r in found.collect()} == {(4, 15, 16, 14), (3, 14, 16, 14)}


def test_short_items(spark):
    """Items of 1 to 14 tokens: whole, and with so few tokens changed that MIN_SHARE is left in one run."""
    items = [(n, " ".join(f"t{n}x{k}" for k in range(n))) for n in range(1, 15)]
    texts, want = [], set()
    for n, item in items:
        for k in [None, *range(n)]:
            w = item.split()
            if k is not None:
                w[k] = "other"
            t = f"some words {' '.join(w)} and more"
            if brute(t, item):
                want.add((len(texts), n))
            texts.append((len(texts), t))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.overlaps(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert want <= found and len(want) > 60
    assert {n for _, n in found} == {n for n, _ in items}
    assert all(sum(a == b for a, b in zip(texts[i][1].split()[2:], dict(items)[n].split())) >= decontam.needed(n) for i, n in found)
