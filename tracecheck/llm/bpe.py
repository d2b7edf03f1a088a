"""Byte-level BPE over rank files: encoding by backtracking, counting by heap merges, decoding.

Encoding and decoding (`Coder`). Bytes are mapped to Latin-1 characters, of which pyahocorasick finds all
vocabulary entries; the longest entry at each place is tried first. An entry may follow another only if merging by
ranks would leave the two side by side; this test is memoised a pair. Where no entry fits, the search steps back
and marks the place, so no place is tried twice and the work is linear in the piece's length. The ids equal those
of exact rank merges.

Counting (`Counter`). Symbols are a linked list, adjacent pairs wait in a heap by rank; the lowest is popped and
merged until none is left. The count is the number of symbols at first minus the merges; no ids are made.

Defined results: a null or empty text has no token. Texts are tokenized whole; very long pieces take time in
proportion to their length (times its logarithm for the counter). Repeated rows each get a row, and a null id is kept.
Of equal ranks in a piece the leftmost pair merges first. An empty table gives an empty table. Columns of the input
that have a new column's name, case aside, are replaced by it.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pretok
from .kit import map_texts, per_document, sha256_hex

#: Pieces and pairs that a worker remembers; on reaching it, it forgets all and starts again.
MEMO = 120_000


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Plain merging of a short piece with ranks under `below`."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Coder:
    """Encodes pieces to ids and decodes ids."""

    def __init__(self, path: str):
        self.ranks = ranks = read_ranks(path)
        self.bytes = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}  # the longest entry that is a proper prefix
        self.halves: dict[int, tuple[int, int]] = {}  # the pair whose merge gives an entry
        self.joined: dict[tuple[int, int], int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
            for size in range(len(token) - 1, 0, -1):
                if (p := ranks.get(token[:size])) is not None:
                    self.shorter[i] = p
                    break
            parts = merge_by_rank(token, ranks, i) if len(token) > 1 else [token]
            if len(parts) == 2:
                self.halves[i] = pair = ranks[parts[0]], ranks[parts[1]]
                self.joined[pair] = i
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves `left` and `right` side by side.

        Undoes merges at their border, the later one first. If a pair that meets at the border would have been
        merged before the merge that hid it, the two can't end up as they are.
        """
        key = left << 20 | right
        if (known := self.fits.get(key)) is not None:
            return known
        if len(self.fits) > MEMO:
            self.fits.clear()
        joined, halves = self.joined, self.halves
        a, b, limit, good = left, right, 1 << 30, True
        while True:
            across = joined.get((a, b))
            if across is not None and across < limit:
                good = False
                break
            later_a, later_b = halves.get(a), halves.get(b)
            if later_a is None and later_b is None:
                break
            # Of two merges the one with the higher rank came later; at equal ranks the left one came first.
            if later_b is None or (later_a is not None and a > b):
                limit, a = a, later_a[1]
            else:
                limit, b = b + 1, later_b[0]
        self.fits[key] = good
        return good

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if (known := self.memo.get(piece)) is not None:
            return known
        n = len(piece)
        longest, size = [0] * n, [0] * n
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            at = end - length + 1
            if length > size[at]:
                longest[at], size[at] = token, length
        length_of, shorter, compatible = self.bytes, self.shorter, self.compatible
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while True:
                end = at + len(length_of[token])
                if not dead[end] and (not out or compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                if (less := shorter.get(token)) is not None:
                    token = less
                    continue
                dead[at] = 1
                token = out.pop()
                at -= len(length_of[token])
                dead_end = shorter.get(token)
                if dead_end is None:
                    continue
                token = dead_end
        found = tuple(out)
        if n <= 64:
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[piece] = found
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's first (n + 1 values)."""
        pieces, code, first = pretok.split(texts)
        found = [self.encode_piece(p) for p in pieces]
        bounds = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=bounds[1:])
        flat = np.fromiter((i for f in found for i in f), np.int32, int(bounds[-1]))
        ids = pretok.gather(code, flat, bounds)
        sizes = (bounds[1:] - bounds[:-1])[code] if len(code) else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_document(sizes, first))])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One for each worker process."""
    return Coder(path)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, to: str = "ids") -> DataFrame:
    """Adds the ids of each text as an array."""

    def each(texts: pa.Array) -> list[pa.Array]:
        ids, first = coder(path).encode(texts)
        return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))]

    return map_texts(docs, text, each, [(to, T.ArrayType(T.IntegerType()))], keep)


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None, to: str = "text") -> DataFrame:
    """Adds the text of each id array (null: null), as a string column."""
    names = encoded.columns if keep is None else keep
    source = encoded.select(*[f"`{c}`" for c in names], encoded[ids].alias("__ids"))
    schema = T.StructType([source.schema[i] for i in range(len(names))] + [T.StructField(to, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [None if x is None else coder(path).decode(x).decode("utf-8", "replace") for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string())], names=[*names, to])

    return source.mapInArrow(run, schema)


_DIGESTS = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def _digests(c: Coder, ids: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    of_ids, of_text = [], []
    listed = ids.tolist()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = listed[a:b]
        of_ids.append(sha256_hex(" ".join(map(str, own)).encode()))
        of_text.append(sha256_hex(c.decode(own)))
    return [pa.array(np.diff(first)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 (of the decoded ids' bytes)."""

    def each(texts: pa.Array) -> list[pa.Array]:
        c = coder(path)
        return _digests(c, *c.encode(texts))

    return map_texts(docs, text, each, _DIGESTS, keep)


def encode_and_check(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the ids and what round_trip adds."""

    def each(texts: pa.Array) -> list[pa.Array]:
        c = coder(path)
        ids, first = c.encode(texts)
        return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())), *_digests(c, ids, first)]

    return map_texts(docs, text, each, [("ids", T.ArrayType(T.IntegerType())), *_DIGESTS], keep)


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Settings of a tokenizer file under which a text's pieces are those of pretok.
_PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def added_tokens(spec: dict) -> re.Pattern[str] | None:
    """A pattern of a file's added tokens, the longest first, as the library finds them; other settings are refused."""
    splitter, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or spec.get("truncation") or any(splitter.get(k) != v for k, v in _PLAIN.items()):
        raise ValueError("only byte-level files without a normalizer, a prefix space or truncation can be counted")
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("only plain merges can be counted")
    added = spec.get("added_tokens") or []
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in what is around them can't be counted")
    names = sorted((t["content"] for t in added), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, names))) if names else None


class Counter:
    """Counts the tokens of pieces under the merges of a tokenizer file (.json, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], _byte_alphabet()
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: (left, right), packed, to the merge's rank and the symbol it gives, packed
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in reversed([*enumerate(pairs)])}
        self.symbol = [0] * 256
        for ch, b in alphabet.items():
            self.symbol[b] = vocab[ch]
        self.special = added_tokens(spec)
        self.memo: dict[bytes, int] = {}

    def count(self, piece: bytes) -> int:
        """Symbols at first less the merges."""
        if (known := self.memo.get(piece)) is not None:
            return known
        n, merges = len(piece), self.merges
        sym = [self.symbol[b] for b in piece]
        heap = []
        for i in range(n - 1):
            if (m := merges.get(sym[i] << 20 | sym[i + 1])) is not None:
                heap.append((m >> 20, i, sym[i], sym[i + 1], m & 0xFFFFF))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = new, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := merges.get(new << 20 | sym[k])) is not None:
                    heapq.heappush(heap, (m >> 20, i, new, sym[k], m & 0xFFFFF))
            if (h := before[i]) >= 0 and (m := merges.get(sym[h] << 20 | new)) is not None:
                heapq.heappush(heap, (m >> 20, h, sym[h], new, m & 0xFFFFF))
        if n <= 64:
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[piece] = left
        return left


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, limit: int = 1024) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit. A special string of the file inside a text is one token."""

    def each(texts: pa.Array) -> list[pa.Array]:
        c = counter(path)
        pieces, code, first, special = pretok.split_around(texts, c.special, pretok.TOKENIZERS)
        sizes = np.fromiter(map(c.count, pieces), np.int64, len(pieces))
        n = per_document(sizes[code] if len(code) else np.zeros(0, np.int64), first) + special
        n_bytes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
        return [pa.array(n_bytes), pa.array(n), pa.array(n > limit)]

    return map_texts(docs, text, each, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], keep)
