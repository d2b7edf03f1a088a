import hashlib
import json
import random
import sys

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tracecheck.llm import bpe, idfile, kit, pretok

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
BITS = ["'s", "'t", "'re", "'ll", "'ve", " ", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "23", "-", "!!", "'", "漢", "🙂", "'S", "\r\n", "_", "²", "\x85", "\x1c", "́", "<|endoftext|>", "ll", "the", " and"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    made = ["".join(r.choice(BITS) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    return [*made, "a" * 4000, "ab" * 3000, "é" * 1500, " " * 700, "=-" * 900, "'" * 50]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_pieces_are_those_of_the_pattern(texts):
    pieces, code, first = pretok.split(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert [pieces[c].decode() for c in code[first[i] : first[i + 1]]] == regex.findall(P.PATTERN, t)


def test_encoding_equals_the_library(texts, library):
    coder = bpe.coder(RANKS)
    ids, first = coder.encode(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        own = ids[first[i] : first[i + 1]].tolist()
        assert own == library.encode_ordinary(t)
        assert coder.decode(own) == t.encode()


def test_counting_equals_the_library(texts):
    tokenizer, counter = Tokenizer.from_file(JSON), bpe.counter(JSON)
    pieces, code, first, special = pretok.split_around(pa.array(texts, pa.large_string()), counter.special, pretok.TOKENIZERS)
    n = kit.per_document(np.array([counter.count(p) for p in pieces])[code], first) + special
    assert n.tolist() == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def around(points):
    """Texts in which each code point meets contractions, letters, digits and blanks."""
    for at in range(0, len(points), 2048):
        yield "".join(f"{c}'s{c}'ve {c}'ll'{c}a{c}1{c} {c}  {c}\n{c}" for c in map(chr, points[at : at + 2048]))


def test_all_code_points_are_split_as_by_the_libraries(library):
    """Of each kind that the package regex sees otherwise, all in every context; of the others, all in one."""
    tokenizer, counter, coder = Tokenizer.from_file(JSON), bpe.counter(JSON), bpe.coder(RANKS)
    valid = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    letters, digits = (np.zeros(sys.maxunicode + 1, bool) for _ in range(2))
    for table, pattern in ((letters, r"\p{L}"), (digits, r"\p{N}")):
        table[[ord(c) for c in regex.findall(pattern, "".join(map(chr, valid)))]] = True
    seen = pretok.classes()
    newer = [c for c in valid if letters[c] != (seen[c] == pretok.LETTER) or digits[c] != (seen[c] == pretok.DIGIT)]
    assert len(newer) > 10_000 and 0x18DC5 in newer
    texts = [*around(newer), *around([0xDC, 0x2028, 0x85, *range(0x250)]), *("".join(f"{chr(c)}'s" for c in valid[at : at + 4096]) for at in range(0, len(valid), 4096)), "\U00018dc5've"]
    ids, first = coder.encode(pa.array(texts, pa.large_string()))
    pieces, code, starts, special = pretok.split_around(pa.array(texts, pa.large_string()), counter.special, pretok.TOKENIZERS)
    n = kit.per_document(np.array([counter.count(p) for p in pieces])[code], starts) + special
    own, own_first = idfile.encoder(JSON).encode(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert ids[first[i] : first[i + 1]].tolist() == library.encode_ordinary(t)
        assert n[i] == len(want) and own[own_first[i] : own_first[i + 1]].tolist() == [*want, idfile.END_ID]
    for lib in (pretok.TIKTOKEN, pretok.TOKENIZERS):  # every code point, as the library's whole pattern cuts it
        assert set(np.unique(pretok.classes(lib))) == {0, 1, 2, 3}
    assert library.encode_ordinary("\U00018dc5've") == [172, 246, 115, 227, 6, 303]


def test_files_with_other_settings_are_refused(tmp_path):
    spec = json.load(open(JSON, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.added_tokens({**spec, **change})
    two = bpe.added_tokens({**spec, "added_tokens": [{"content": "<|a|>"}, {"content": "<|a|>b"}]})
    assert two.findall("x<|a|>b<|a|>") == ["<|a|>b", "<|a|>"]


def test_counts_of_odd_rows(odd, none):
    tokenizer = Tokenizer.from_file(JSON)
    found = bpe.count_tokens(odd, JSON, keep=["doc_id", "text"]).collect()
    assert len(found) == odd.count()
    for r in found:
        t = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 1024)
    assert bpe.count_tokens(none, JSON, keep=["doc_id"]).count() == 0


def test_round_trip_of_odd_rows(odd, none, library):
    found = bpe.round_trip(odd, RANKS, keep=["doc_id", "text"]).collect()
    assert len(found) == odd.count()
    for r in found:
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(none, RANKS, keep=["doc_id"]).count() == 0


def test_ids_decode_to_texts(odd):
    back = bpe.decode(bpe.encode(odd, RANKS, keep=["doc_id", "text"]), RANKS, keep=["doc_id", "text"], to="again").collect()
    assert all(r.again == (r.text or "") for r in back)
