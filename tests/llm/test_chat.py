import random

import pytest

from tracecheck.llm import chat

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "<", "[", " ok ", "\n", "é🙂", "<\\s>", "[\\\\INST]"]


def text(r):
    return "".join(r.choice(PARTS) for _ in range(r.randint(0, 8)))


def test_escape_is_reversible():
    r = random.Random(1)
    for _ in range(5000):
        t = text(r)
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(m in e for m in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[/ROLE]", "[ROLE]"))


@pytest.mark.parametrize("batch", [200, 8 << 20])
def test_round_trip(spark, monkeypatch, batch):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None, 'o"d\nd', "[/ROLE]"]), r.choice([None, text(r), text(r)])) for c in [None, *range(40)] for t in range(r.randint(1, 6))]
    rows += [(7, 0, "user", "tie"), (7, 0, "user", "tie")]
    want: dict = {}
    for c, t, role, x in sorted(rows, key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2] is not None, k[2] or "", k[3] or "")):
        want.setdefault(c, []).append((role, x or ""))
    monkeypatch.setattr(chat, "BATCH_BYTES", batch)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {x.conv_id: x for x in chat.format_conversations(df).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        assert chat.parse(got[c].formatted) == turns
        loss = [chat.unescape(got[c].formatted[s["start"] : s["end"]]) for s in got[c].loss]
        assert loss == [x for role, x in turns if role == "assistant"]


def test_long_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    long = [(1, k, "assistant" if k % 2 else "user", "x" * 1000) for k in range(3000)]
    (row,) = chat.format_conversations(spark.createDataFrame(long, schema)).collect()
    assert len(chat.parse(row.formatted)) == 3000
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0
