"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate spans (their shape as one string, digits, checksums, borders, the words before
them) together with a type, and a dynamic programme over spans of bounded length chooses boundaries and types
jointly. Only spans with a digit or an at sign can be entities, so texts are decoded in windows around these
characters; everywhere else each token is outside an entity by definition, which makes this equal to decoding the
whole text. The field is trained on made-up sentences when it is first used (seeded, so always the same).

Defined results: a null or empty text has no span. Pattern spans always stay; a span of the field is added only if
it overlaps none of them. Ties between equally good segmentations go to the one with the shorter last span, then to
the type listed first. Long runs of digits take time in proportion to their length. A null id is kept, and repeated rows
each get a row. An empty table gives an empty table. Columns of the input that have a new column's name, case aside, are
replaced by it.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kit import map_texts, sha256_hex

#: Kinds in the order of output. The first four have fixed patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "id")
#: Tokens in a span at most.
MAX_TOKENS = 14
#: Tokens of a window on each side of a digit or an at sign.
MARGIN = MAX_TOKENS

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, so later places in a run needn't be tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches; each at sign is tried once, with all the local part before it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by kind and start."""
    found = emails(text)
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


# --- the field ---

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_TRIGGER = re.compile(r"[0-9@]")
_SHAPES = tuple(
    re.compile(p)
    for p in (
        r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+",
        r"\d{1,3}(?:\.\d{1,3}){3}",
        r"\d{4}(?:([ -]?)\d{4})(?:\1\d{4})(?:\1\d{1,7})?",
        r"\+\d[\d ().-]{7,}\d",
        r"\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}",
        r"\d{3}-\d{2}-\d{4}",
        r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}",
        r"(?=.*\d)(?=.*[a-z])[0-9a-f]{16,}",
        r"(?=.*\d)[A-Z]{4}[A-Z0-9]{12,}",
        r"\d+",
        r"\d+\.\d+\.?",
        r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}",
    )
)
_CUES = (
    frozenset(("password", "passwd", "token", "secret", "key", "apikey", "pwd")),
    frozenset(("tel", "phone", "call", "fax", "mobile")),
    frozenset(("card", "visa", "credit")),
    frozenset(("ssn", "iban", "social", "account", "id")),
    frozenset(("ip", "host", "address")),
    frozenset(("version", "license", "page", "chapter", "section", "year", "isbn")),
)
_DIGIT_STEPS = (1, 4, 7, 9, 11, 13, 16, 20)


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Numbers of the features that hold for the span of tokens i to j (j exclusive)."""
    start, end = tokens[i][0], tokens[j - 1][1]
    s = text[start:end]
    on = [0]
    n = 1
    for k, shape in enumerate(_SHAPES):
        if shape.fullmatch(s):
            on.append(n + k)
    n += len(_SHAPES)
    digits = _NOT_DIGIT.sub("", s)
    on.append(n + sum(len(digits) >= x for x in _DIGIT_STEPS))
    n += len(_DIGIT_STEPS) + 1
    before, after = text[start - 1 : start], text[end : end + 1]
    follows = text[end + 1 : end + 2]
    tests = (
        13 <= len(digits) <= 19 and luhn(digits),
        "@" in s,
        s[0] == "+",
        any(c.isspace() for c in s),
        any(c.isalpha() for c in s),
        s.count("(") != s.count(")"),
        not (s[0].isalnum() or s[0] in "+("),
        not s[-1].isalnum(),
        before.isalnum() or before == "@" or (before in "._%-+" and before != ""),
        after.isalnum() or after == "@" or (after in ".-" and follows.isalnum()),
        before == "=" or before == '"',
        (before == " " and start > 1 and text[start - 2].isdigit()) or (after == " " and follows.isdigit()),
        j - i == 1,
        "=" in s or '"' in s,
    )
    on += [n + k for k, t in enumerate(tests) if t]
    n += len(tests)
    words = {text[a:b].lower() for a, b in tokens[max(0, i - 4) : i]}
    on += [n + k for k, cue in enumerate(_CUES) if cue & words]
    return on


N_FEATURES = 1 + len(_SHAPES) + len(_DIGIT_STEPS) + 1 + 14 + len(_CUES)


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens around digits and at signs; a run ends at a line's end."""
    if not _TRIGGER.search(text):
        return []
    found: list[list[tuple[int, int]]] = []
    at = 0
    for line in text.split("\n"):
        if _TRIGGER.search(line):
            tokens = [(at + m.start(), at + m.end()) for m in _TOKEN.finditer(line)]
            marks = [k for k, (a, b) in enumerate(tokens) if _TRIGGER.search(text, a, b)]
            last = -1
            for k in marks:
                a, b = max(0, k - MARGIN), min(len(tokens), k + MARGIN + 1)
                if found and last >= 0 and a <= last:
                    found[-1] += tokens[last:b]
                else:
                    found.append(tokens[a:b])
                last = max(b, last)
        at += len(line) + 1
    return found


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (i, j) that can be entities: bounded, with a digit or an at sign, and no wide gap inside."""
    n = len(tokens)
    marked = np.zeros(n + 1, np.int64)
    np.cumsum([bool(_TRIGGER.search(text, a, b)) for a, b in tokens], out=marked[1:])
    count, found = marked.tolist(), []
    for i in range(n):
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            if j > i + 1 and tokens[j - 1][0] - tokens[j - 2][1] > 1:
                break
            if count[j] > count[i]:
                found.append((i, j))
    return found


class Field:
    """Weights by feature and kind, and by whether an entity follows another at once."""

    def __init__(self, weights: np.ndarray, follow: float):
        self.weights, self.follow = weights, follow

    def scores(self, text: str, tokens: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[list[int]]]:
        on = [features(text, tokens, i, j) for i, j in spans]
        sizes = [len(x) for x in on]
        flat = self.weights[[k for x in on for k in x]]
        return np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64), axis=0), on

    def decode(self, text: str) -> list[Span]:
        found: list[Span] = []
        for tokens in windows(text):
            spans = candidates(text, tokens)
            if not spans:
                continue
            score = self.scores(text, tokens, spans)[0]
            kind, best = score.argmax(axis=1).tolist(), score.max(axis=1).tolist()
            n = len(tokens)
            by_end: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
            for (i, j), s, k in zip(spans, best, kind, strict=True):
                if s > 0 or self.follow > 0:
                    by_end[j].append((i, s, k))
            # value[j][e]: best score of the first j tokens, e: whether an entity ends there
            value = [[0.0, -math.inf]]
            back: list[tuple] = [()]
            for j in range(1, n + 1):
                v0 = max(value[j - 1])
                v1, how = -math.inf, None
                for i, s, k in reversed(by_end[j]):
                    a, b = value[i][0] + s, value[i][1] + s + self.follow
                    if max(a, b) > v1:
                        v1, how = max(a, b), (i, k, int(b > a))
                value.append([v0, v1])
                back.append(how)
            j, e = n, int(value[n][1] > value[n][0])
            mine = []
            while j > 0:
                if e:
                    i, k, e = back[j]
                    mine.append((KINDS[k], tokens[i][0], tokens[j - 1][1]))
                    j = i
                else:
                    j -= 1
                    e = int(value[j][1] > value[j][0])
            found += reversed(mine)
        return found


def _logsum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _gradient(field: Field, text: str, tokens: list[tuple[int, int]], gold: set[tuple[int, int, int]]) -> tuple[np.ndarray, float]:
    """Observed less expected features of one window: forward and backward sums over all segmentations."""
    spans = candidates(text, tokens)
    grad, follow = np.zeros_like(field.weights), 0.0
    if not spans:
        return grad, follow
    score, on = field.scores(text, tokens, spans)
    total = np.logaddexp.reduce(score, axis=1).tolist()
    n, t = len(tokens), field.follow
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    begins: list[list[int]] = [[] for _ in range(n + 1)]
    for x, (i, j) in enumerate(spans):
        ends[j].append(x)
        begins[i].append(x)
    f = [[0.0, -math.inf]]
    for j in range(1, n + 1):
        one = -math.inf
        for x in ends[j]:
            i = spans[x][0]
            one = _logsum(one, _logsum(f[i][0], f[i][1] + t) + total[x])
        f.append([_logsum(*f[j - 1]), one])
    b = [[0.0, 0.0] for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        out, plain, after = b[i + 1][0], -math.inf, -math.inf
        for x in begins[i]:
            v = total[x] + b[spans[x][1]][1]
            plain, after = _logsum(plain, v), _logsum(after, v + t)
        b[i] = [_logsum(out, plain), _logsum(out, after)]
    z = _logsum(*f[n])
    inside = np.exp(score - np.array(total)[:, None])
    for x, (i, j) in enumerate(spans):
        p0, p1 = math.exp(min(0, f[i][0] + total[x] + b[j][1] - z)), math.exp(min(0, f[i][1] + t + total[x] + b[j][1] - z))
        follow -= p1
        if p0 + p1 > 1e-9:
            grad[on[x]] -= (p0 + p1) * inside[x]
        for k in range(len(KINDS)):
            if (i, j, k) in gold:
                grad[on[x], k] += 1
    return grad, follow + sum(any(g[1] == h[0] for g in gold) for h in gold)


def _with_check_digit(r: random.Random, size: int) -> str:
    body = "".join(str(r.randrange(10)) for _ in range(size - 1))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def _made_up(r: random.Random) -> tuple[str, list[Span]]:
    """A sentence with entities and look-alikes."""
    num = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    word = lambda: "".join(r.choice("abdeghilnorstuéü") for _ in range(r.randint(2, 9)))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))

    def entity() -> tuple[str, str | None, str, str]:
        kind = r.choice((*KINDS, "secret", None, None))
        if kind == "email":
            return "", kind, f"{word().encode('ascii', 'ignore').decode() or 'a'}{r.choice(('.', '_', ''))}{num(r.randint(0, 2))}x@{r.choice(('mail', 'box'))}{num(1)}.{r.choice(('example', 'test'))}.{r.choice(('com', 'org', 'fr'))}", ""
        if kind == "ip":
            return r.choice(("", "host ", "ip ")), kind, ".".join(str(r.randrange(1, 256)) for _ in range(4)), ""
        if kind == "card":
            d, sep = _with_check_digit(r, 16), r.choice(("", " ", "-"))
            return r.choice(("", "card ")), kind, sep.join(d[k : k + 4] for k in range(0, 16, 4)), ""
        if kind == "phone":
            form = r.randrange(4)
            body = f"({num(3)}) {num(3)}-{num(4)}" if form < 2 else f"{num(3)}-{num(3)}-{num(4)}"
            return r.choice(("", "call ", "tel ")), kind, (f"+{r.randint(1, 99)} " if form in (0, 2) else "") + body, ""
        if kind == "id":
            return r.choice(("ssn ", "social ", "iban ")), kind, r.choice((f"{num(3)}-{num(2)}-{num(4)}", f"DE{num(2)} {num(4)} {num(4)} {num(4)} {num(4)}")), ""
        if kind == "secret":
            form = r.randrange(3)
            if form == 0:
                return "", kind, "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(15)) + num(1), ""
            return (("password=", kind, hexa(17) + num(1), "") if form == 1 else (r.choice(('token = "', 'key = "')), kind, hexa(38) + num(1) + "a", '"'))
        return r.choice(("", "version ", "page ", "in ")), None, r.choice((num(1) + "." + num(1), num(4), num(2), f"{num(2)}/{num(2)}/{num(4)}", num(r.randint(5, 11)), num(1) + "." + num(2) + "." + num(1), _with_check_digit(r, 16)[:15] + "x", num(3) + " " + num(3))), ""

    text, spans = "", []
    for _ in range(r.randint(1, 2)):
        text += "".join(word() + r.choice((" ", " ", " ", ", ", ". ")) for _ in range(r.randint(0, 4)))
        lead, kind, value, tail = entity()
        text += lead
        if kind:
            spans.append((kind, len(text), len(text) + len(value)))
        text += value + tail + r.choice((" ", " ", ", ", ". "))
    return text + word(), spans


@lru_cache(maxsize=1)
def train(sentences: int = 260, rounds: int = 4, seed: int = 7, rate: float = 0.4) -> Field:
    """Maximum likelihood by stochastic gradient steps with AdaGrad; the same weights each time."""
    r = random.Random(seed)
    field = Field(np.zeros((N_FEATURES, len(KINDS))), 0.0)
    field.weights[0] = -2.0
    made = [_made_up(r) for _ in range(sentences)]
    square = np.full_like(field.weights, 1e-2)
    for _ in range(rounds):
        for text, spans in made:
            for tokens in windows(text):
                starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: j + 1 for j, (_, b) in enumerate(tokens)}
                gold = {(starts[a], ends[b], KINDS.index(k)) for k, a, b in spans if a in starts and b in ends}
                grad, follow = _gradient(field, text, tokens, gold)
                grad -= 1e-4 * field.weights
                square += grad * grad
                field.weights += rate * grad / np.sqrt(square)
                field.follow += 0.02 * follow
        r.shuffle(made)
    return field


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The pattern spans, and these with the field's spans that overlap none of them, by kind and start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    merged: list[list[int]] = []
    for a, b in taken:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    more = []
    for span in field.decode(text):
        at = np.searchsorted(starts, span[2], side="left")
        if at == 0 or merged[at - 1][1] <= span[1]:
            more.append(span)
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone and base_sha256 (pattern spans), and spans (all, joined)."""
    field = train()

    def each(texts: pa.Array) -> list[pa.Array]:
        counts: list[list[int]] = [[] for _ in BASE_KINDS]
        digest, listed = [], []
        for t in texts.to_pylist():
            base, spans = all_spans(t, field)
            for k, c in zip(BASE_KINDS, counts, strict=True):
                c.append(sum(s[0] == k for s in base))
            digest.append(sha256_hex(joined(base).encode()))
            listed.append(joined(spans))
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(listed, pa.string())]

    fields = [*((f"n_{k}", T.LongType()) for k in BASE_KINDS), ("base_sha256", T.StringType()), ("spans", T.StringType())]
    return map_texts(docs, text, each, fields, keep)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in capitals and angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", to: str = "__masked") -> DataFrame:
    """Adds the masked text in column `to`."""
    field = train()

    def each(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([mask(t, all_spans(t, field)[1]) for t in texts.to_pylist()], pa.string())]

    return map_texts(docs, text, each, [(to, T.StringType())])
