import random
import re

from tracecheck.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return out


def test_fixed_patterns():
    r = random.Random(2)
    for alphabet in ("ab@.-1 %é", "12..0 a", "4111 -1", "+1 ().-23a", "a@b.c 1.2+()-\n"):
        for _ in range(3000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(t) == brute(t)
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+" + "1 " * 100_000):
        pii.base_spans(t)


def test_held_out_accuracy():
    field, r = pii.train(), random.Random(99)
    hit = missed = wrong = 0
    for _ in range(300):
        text, gold = pii._made_up(r)
        found, gold = set(field.decode(text)), set(gold)
        hit, missed, wrong = hit + len(gold & found), missed + len(gold - found), wrong + len(found - gold)
    assert hit / (hit + missed) > 0.95 and hit / (hit + wrong) > 0.95


def test_decoding_equals_exhaustive_search():
    """The best segmentation of short windows, by trying all of them."""
    field, r = pii.train(), random.Random(4)
    for _ in range(25):
        text = " ".join(r.choice(["x1", "12", "a@b", "w", "4.4", "+9"]) for _ in range(4))
        tokens = pii.windows(text)[0] if pii.windows(text) else []
        spans = pii.candidates(text, tokens)
        if not spans or len(tokens) > 9:
            continue
        score = field.scores(text, tokens, spans)[0].max(axis=1)
        by_start = {}
        for (i, j), s in zip(spans, score, strict=True):
            by_start.setdefault(i, []).append((j, s))

        def best(i, after, n=len(tokens), by_start=by_start):
            if i == n:
                return 0.0
            out = best(i + 1, False)
            for j, s in by_start.get(i, []):
                out = max(out, s + (field.follow if after else 0) + best(j, True))
            return out

        found = field.decode(text)
        index = {tokens[i][0]: i for i in range(len(tokens))}
        ends = {tokens[j][1]: j + 1 for j in range(len(tokens))}
        own = 0.0
        last = None
        for k, a, b in found:
            x = spans.index((index[a], ends[b]))
            own += field.scores(text, tokens, spans)[0][x, pii.KINDS.index(k)] + (field.follow if last == index[a] else 0)
            last = ends[b]
        assert abs(own - best(0, False)) < 1e-9


def test_odd_rows(odd, none):
    rows = {r.doc_id: r for r in pii.find(odd, keep=["doc_id"]).collect()}
    assert rows[1].spans == rows[2].spans == ""
    assert (rows[11].n_email, rows[11].n_phone, rows[11].n_ip, rows[11].n_card) == (1, 1, 1, 0)
    assert pii.find(odd, keep=["doc_id"]).count() == odd.count() and pii.find(none, keep=["doc_id"]).count() == 0


def test_base_spans_stay_and_masks(sample):
    field = pii.train()
    for _, t in sample[:60]:
        base, spans = pii.all_spans(t, field)
        assert set(base) <= set(spans) and base == brute(t)
    assert pii.mask("a jo@x.com b", [("email", 2, 10)]) == "a <EMAIL> b"
    assert pii.mask("0123456789", [("ip", 2, 6), ("card", 4, 8)]) == "01<IP>89"
