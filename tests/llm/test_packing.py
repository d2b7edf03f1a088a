import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracecheck.llm import packing
from tracecheck.llm.queries import QUERIES, vocabulary

JSON = vocabulary("byte_bpe_50k.json")


def held_to(pieces, docs):
    """Checks pieces against the library's ids; docs: (doc_id, text), ids distinct. Returns the sequences' lengths."""
    library = Tokenizer.from_file(JSON)
    ids = {i: np.array([*e.ids, packing.END_ID], "<u4") for (i, _), e in zip(docs, library.encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True)}
    ends, sequences = dict.fromkeys(ids, 0), defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == ends[p.doc_id] and p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        ends[p.doc_id] += p.length
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        sequences[p.sequence_id].append(p)
    assert ends == {i: len(x) for i, x in ids.items()}
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert {(p.sequence_length, len({x.step_group for x in own})) for p in own} == {(at, 1)} and at <= 2048
    return [own[0].sequence_length for own in sequences.values()]


def padding(lengths):
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths)


def test_query_against_the_library(spark, sample):
    lengths = held_to(QUERIES["op11_multi_length_packing"](spark, "/root/testdata/sf0.001").collect(), sample)
    assert padding(lengths) == 0 and sum(n in packing.TIERS for n in lengths) >= len(lengths) - 11


def test_many_tasks_and_blocks(spark, sample, monkeypatch):
    docs = spark.createDataFrame(sample, "doc_id long, text string")
    lengths = held_to(packing.packed(docs.repartition(5), JSON).collect(), sample)
    assert padding(lengths) == 0 and sum(n not in packing.TIERS for n in lengths) <= 5 * 11
    steps = defaultdict(int)
    for p in packing.packed(docs.coalesce(1), JSON).collect():
        steps[p.step_group] += p.length
    assert max(steps.values()) - min(steps.values()) <= 2048 and max(steps.values()) <= packing.STEP_IDS + 2048


@pytest.mark.parametrize("seed", range(30))
def test_windows_are_full(seed):
    rng = random.Random(seed)
    sizes = [(rng.randrange(50), rng.choice([1, rng.randrange(1, 30), rng.randrange(1, 300), rng.randrange(1, 9000), 2048, 4096])) for _ in range(rng.randrange(60))]
    windows, left = packing.pack(sizes)
    assert all(sum(p.size for p in w) in packing.TIERS for w in windows) and sum(p.size for p in left) < 2048
    ends = packing.closed(left)
    assert all((n := sum(p.size for p in w)) & (n - 1) == 0 for w in ends)
    covered = defaultdict(list)
    for w in windows + ends:
        at = 0
        for p in w:
            assert p.offset == at
            at += p.size
            covered[p.doc].append((p.start, p.start + p.size))
    for doc, (start, size) in enumerate(sizes):
        own = sorted(covered[doc])
        assert own[0][0] == start and own[-1][1] == start + size and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_blocks_go_on_in_the_next():
    packer, rows = packing.Packer(3), []
    rng = np.random.default_rng(2)
    docs = {i: rng.integers(0, 50_000, int(rng.integers(1, 3000))).astype("<u4") for i in range(40)}
    for i, ids in docs.items():
        packer.add(i, ids)
        if i % 7 == 6:
            rows += packer.block(False).to_pylist()
            assert packer.waiting < 2048
    rows += packer.block(True).to_pylist()
    got = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(docs[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(docs[r["doc_id"]])
        got[r["doc_id"]].append((r["start"], r["length"]))
    assert all(sum(n for _, n in got[i]) == len(ids) and sorted(got[i])[0][0] == 0 for i, ids in docs.items())
    assert len({r["sequence_id"] for r in rows}) == packer.sequences


def test_odd_rows(spark, odd, none):
    rows = packing.packed(odd, JSON).collect()
    library = Tokenizer.from_file(JSON)
    want = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert sum(p.length for p in rows) == want and [p.doc_id for p in rows].count(None) >= 2
    assert sorted(p.length for p in rows if p.doc_id in (1, 2)) == [1, 1]
    assert packing.packed(none, JSON).count() == 0
