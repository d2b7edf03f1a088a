import cProfile
import pstats
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracecheck.llm import idcodec, idfile

JSON = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 5, 100, 2047, 2048, 2049, 9000])
@pytest.mark.parametrize("kinds", [1, 3, 300, 65536])
def test_codec_round_trip(n, kinds):
    ids = np.random.default_rng(n * kinds).integers(0, kinds, n)
    frame = idcodec.encode_frame(ids)
    assert (idcodec.decode_frame(frame) == ids).all()
    for k in range(-(-n // idcodec.BLOCK)):
        assert (idcodec.decode_block(frame, k) == ids[k * idcodec.BLOCK : (k + 1) * idcodec.BLOCK]).all()


def test_codec_edges():
    assert len(idcodec.decode_frame(idcodec.encode_frame(np.zeros(0, int)))) == 0
    with pytest.raises(ValueError):
        idcodec.encode_frame(np.array([-1]))
    wide = np.random.default_rng(5).integers(0, 200_000, 5000)
    assert (idcodec.decode_frame(idcodec.encode_frame(wide)) == wide).all()
    assert (idcodec.decode_block(idcodec.encode_frame(wide), 1) == wide[2048:4096]).all()
    ids = np.tile(np.random.default_rng(0).integers(0, 50000, 50), 200)
    frame = idcodec.encode_frame(ids)
    assert len(frame) < len(ids) / 4  # repeated contexts are predicted
    broken = bytearray(frame)
    broken[-3] ^= 1
    with pytest.raises(idcodec.DamagedBlock):
        idcodec.decode_frame(bytes(broken))


def test_order_0_predicts_whole_ids():
    """Ids that come again without their context cost less than their number of bits."""
    few = np.random.default_rng(7).integers(0, 50_000, 40)
    ids = np.random.default_rng(8).choice(few, 20_000)
    assert 8 * len(idcodec.encode_frame(ids)) / len(ids) < 7.5  # log2(40) is 5.3; 16 bits with bare low bytes took over 11


def test_file(spark, odd, none, tmp_path):
    tokenizer = Tokenizer.from_file(JSON)
    idfile.write(odd, f"file://{tmp_path}/ids", JSON, partitions=3)
    rows = sorted(idfile.read(spark, f"file://{tmp_path}/ids").collect(), key=lambda r: r.start)
    want = sorted(((i is not None, i or 0, t or "") for i, t in odd.select("doc_id", "text").collect()))
    assert [r.doc_id for r in rows] == [i if has else None for has, i, _ in want]
    start = 0
    for r, (_, _, t) in zip(rows, want, strict=True):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    idfile.write(none, f"file://{tmp_path}/none", JSON)
    assert idfile.read(spark, f"file://{tmp_path}/none").count() == 0


def test_many_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idfile, "FRAME_IDS", 50)
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["a", "bb", "ccc"]) for _ in range(r.randint(0, 90)))) for i in range(60)]
    idfile.write(spark.createDataFrame(docs, "doc_id long, text string"), f"file://{tmp_path}/f", JSON, partitions=2)
    rows = sorted(idfile.read(spark, f"file://{tmp_path}/f").collect(), key=lambda x: x.doc_id)
    assert [x.doc_id for x in rows] == [i for i, _ in docs]
    assert [x.start for x in rows] == [0, *np.cumsum([x.n_tokens for x in rows])[:-1].tolist()]


def test_calls_an_id():
    """What a step costs is mostly its calls: each id's step makes few of them, however it is coded."""
    ids = np.random.default_rng(3).integers(0, 50_000, 3 * idcodec.BLOCK)
    frame = idcodec.encode_frame(ids)
    for run in (lambda: idcodec.encode_frame(ids), lambda: idcodec.decode_frame(frame)):
        with cProfile.Profile() as profile:
            run()
        assert pstats.Stats(profile).total_calls < 52 * idcodec.BLOCK


def test_pieces_go_to_the_merges_at_once():
    """Texts are split once: plain pieces aren't split again by the library, and each is merged once."""
    texts = ["It's  a test, naïve 中文 ️x\n\t1234 \x00\xa0\xad end ", "", "a test" * 3, "it's it's"]
    whole = Tokenizer.from_file(JSON)
    own, merged = idfile.Encoder(JSON), []
    merge = own.merges
    own.tokenizer = None
    own.merges = lambda piece: merged.append(piece) or merge(piece)
    for _ in range(2):
        ids, start = own.encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(start[:-1], start[1:], strict=True)] == [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert len(merged) == len(set(merged))


def test_the_writer_follows_slots_instead_of_steps():
    """The writer's model is worked out for whole blocks, so a step only moves the coder; it is what the reader finds step by step."""
    ids = np.random.default_rng(4).choice(np.random.default_rng(5).zipf(1.3, 900) % 65536, 2 * idcodec.BLOCK)
    ids[700:1400] = ids[:700]  # contexts that come again
    with cProfile.Profile() as profile:
        idcodec.encode_frame(ids)
    assert pstats.Stats(profile).total_calls < 10 * idcodec.BLOCK  # 22 for each step before
    x = ids.reshape(2, -1).astype(np.int32)
    rest, hit, *_ = idcodec._modelled(x)
    model = idcodec._Model(2)
    for t in range(idcodec.BLOCK):
        if t in idcodec._MIX:
            model.mix()
        model.predict()
        assert (model.rest == rest[:, t]).all() and ((model.id == x[:, t]) == hit[:, t]).all()
        model.update(x[:, t], hit[:, t])


def test_pieces_that_come_again_stay_known(monkeypatch):
    """A full memory forgets the pieces that only one slice had, not those in use."""
    monkeypatch.setattr(idfile, "MEMO", 300)
    own, merged = idfile.Encoder(JSON), []
    merge = own.merges
    own.merges = lambda piece: merged.append(piece) or merge(piece)
    whole = Tokenizer.from_file(JSON)
    for k in range(12):
        text = "these words come again " + " ".join(f"w{chr(97 + k)}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90))
        ids, _ = own.encode(pa.array([text], pa.large_string()))
        assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0]
    assert len(own.known) < 500 and len(merged) == len(set(merged))
    own.used[:] = 2
    own.thin()  # too many are in use: none stays
    assert not own.known and own.encode(pa.array(["these words"], pa.large_string()))[0].tolist() == [*whole.encode("these words", add_special_tokens=False).ids, 0]


def test_no_frame_of_few_blocks(spark, tmp_path, monkeypatch):
    """What a task has beyond a full frame isn't left to a frame of few blocks, whose steps cost as many calls."""
    monkeypatch.setattr(idfile, "FRAME_IDS", 100)
    for n in (21, 29, 33, 52):  # documents of 5 ids: 105 to 260 ids
        docs = spark.createDataFrame([(i, "a a a a") for i in range(n)], "doc_id long, text string")
        idfile.write(docs, f"file://{tmp_path}/f{n}", JSON, partitions=1)
        sizes = [r.n_ids for r in spark.read.parquet(f"file://{tmp_path}/f{n}").orderBy("start").collect()]
        assert sum(sizes) == 5 * n and max(sizes) <= 100 and min(sizes) >= 50


def test_many_pieces_go_to_the_merges_in_one_call():
    """The library is called for thousands of pieces, not for each; also where no byte is free to stand between pieces."""
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}é" for i in range(600)), "\n\x00ÿÁ\xc0 õþ" * 3]
    whole = Tokenizer.from_file(JSON)
    for inner in (None, ord(idfile._BETWEEN)):
        own, merged = idfile.Encoder(JSON), []
        own.inner = inner or own.inner
        merge = own.merges
        own.merges = lambda text, merge=merge, merged=merged: merged.append(text) or merge(text)
        ids, start = own.encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(start[:-1], start[1:], strict=True)] == [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert len(own.known) > 600 and len(merged) == 1
