"""Benchmark decontamination by spaced-seed hashing.

Tokens are words, lower-cased and stripped of everything but letters and digits. A mask picks SEED_WEIGHT of the
tokens in a short window and ignores the others, so a substituted token between them does no harm. Hashes of the
benchmark's windows are joined to those of the training texts under each mask; around each hit the whole benchmark
item is laid along the document on the hit's diagonal, and each maximal run of tokens, scored +1 for an equal token and
-MISMATCH for another, is an overlap. An overlap counts from MIN_MATCHED equal tokens on (or MIN_SHARE of an item
that is shorter). Items of which MIN_SHARE is less than a longer item needs are found without masks: a match misses few
of their tokens, so one of a few contiguous pieces is whole. Of a document and an item, the overlap with most equal
tokens is given.

The benchmark's size is looked up first. Up to BLOCK_ITEMS items and BLOCK_BYTES it is sent to the executors, which
search it while they scan the texts; these are then never shuffled. A larger one is joined: window hashes of texts and
items meet by a shuffle, and each pair of a text and an item that share one is verified once, for equal texts together.
Both ways give the same rows, and either scans the texts' windows once.

Text and item that both repeat themselves share windows on nearly all diagonals. Where hits are over FEW_HITS times the
two texts' tokens, all diagonals are looked at instead, those that could hold the longest overlap first, and only as
long as one may beat the best so far; so neither time nor memory grows with the product of the repetitions.

Defined results: a null or empty text, or one without a token, matches nothing; a null item id is kept as null.
Repeated items or rows each give their own matches. Of equally long overlaps, that on the diagonal with more of the
item inside the text is given, then that of the leftmost diagonal, then the first on it. An empty table or benchmark
matches nothing. Texts and items are used whole; other columns, whatever their names, don't take part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .kit import checkpoint, free_name, map_texts, slices, text_array

#: Token positions that count, within a window.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 7, 8), (0, 2, 4, 5, 7, 9), (0, 1, 4, 6, 7, 10))
MISMATCH, MIN_MATCHED, MIN_SHARE = 3, 12, 0.8
#: Items and text bytes of a benchmark that is sent to the executors, at most.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
#: Hits of a text and an item that are followed one by one, as a multiple of their tokens.
FEW_HITS = 4
#: Hits that are held at once, at most; diagonals that are looked at together, at most, and one by one at first.
HELD, TOGETHER, AT_FIRST = 1 << 22, 4096, 16

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def normal(word: bytes) -> bytes:
    return "".join(c for c in word.decode("utf-8", "replace").lower() if c.isalnum()).encode()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each token (words without letter or digit drop out), and each text's first (n + 1 values)."""
    raw, _, starts, ends, first = words.of(texts)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    code = words.codes(raw, starts, ends)
    where = np.zeros(int(code.max()) + 1, np.int64)
    where[code[::-1]] = np.arange(len(code))[::-1]  # the first place of each distinct word
    forms = [normal(bytes(raw[a:b])) for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
    table = np.array([xxhash.xxh64_intdigest(f) if f else 0 for f in forms], np.uint64)
    hashes = table[code]
    keep = hashes != 0
    total = np.zeros(len(code) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return hashes[keep], total[first]


def window_hashes(hashes: np.ndarray, first: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The masked hash of each window that lies in one text, and its first token."""
    span = mask[-1] + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for k, p in enumerate(mask):
        value += hashes[p : p + n] * _MIX[k]
    value ^= value >> np.uint64(29)
    inside = np.repeat(first[1:] - span, np.diff(first))[:n] >= np.arange(n)
    at = np.flatnonzero(inside)
    return value[at], at


def needed(size: int) -> int:
    return min(MIN_MATCHED, max(1, int(np.ceil(MIN_SHARE * size))))


def pieces(size: int) -> list[tuple[int, int]]:
    """(start, tokens) pieces of a short item, one of which is whole in every match; none for longer items."""
    parts = size - needed(size) + 1
    if not size or int(np.ceil(MIN_SHARE * size)) > MIN_MATCHED or size // parts > len(_MIX) - 1 and parts > 1:
        return []
    ends = [size * k // parts for k in range(parts + 1)]
    return [(a, min(b - a, len(_MIX))) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def runs(equal: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each maximal run: no part in front of it or behind it that could be added keeps its score."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]])))
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    found: list[tuple[int, int, int, int]] = []
    for a, b in edges.reshape(-1, 2).tolist():
        low, high = int(total[a]), int(total[b])
        while True:
            j = next((j for j in range(len(found) - 1, -1, -1) if found[j][0] <= low), None)
            if j is None or found[j][1] > high:
                found.append((low, high, a, b))
                break
            low, _, a, _ = found[j]
            del found[j:]
    return [(a, b) for _, _, a, b in found]


def most_matched(doc: np.ndarray, item: np.ndarray, at: np.ndarray, need: int) -> tuple[int, int, int] | None:
    """(first token, tokens, equal tokens) of the best overlap on the diagonals `at` (the item's first token's place)."""
    n, m = len(doc), len(item)
    size = np.minimum(at + m, n) - np.maximum(at, 0)
    order = np.lexsort((at, -size))
    found: tuple[int, int, int] | None = None
    least = need  # equal tokens that a better overlap has at least

    def look(d: int) -> None:
        nonlocal found, least
        a, b = max(d, 0), min(d + m, n)
        equal = doc[a:b] == item[a - d : b - d]
        for start, end in runs(equal) if np.count_nonzero(equal) >= least else ():
            if (matched := int(np.count_nonzero(equal[start:end]))) >= least:
                found, least = (a + start, end - start, matched), matched + 1

    for d in at[order[:AT_FIRST]].tolist():
        look(d)
    rest = at[order[AT_FIRST:][size[order[AT_FIRST:]] >= least]]
    padded = np.concatenate([np.zeros(m, np.uint64), doc, np.zeros(m, np.uint64)]) if len(rest) else doc
    for k in range(0, len(rest), TOGETHER):
        own = rest[k : k + TOGETHER]
        if min(own[0] + m, n) - max(own[0], 0) < least:
            break
        # No run has more equal tokens than the stretch it lies in, which ends where the score falls below zero.
        score, matched, top = (np.zeros(len(own), np.int32) for _ in range(3))
        for j in range(m):
            equal = padded[own + (m + j)] == item[j]
            matched += equal
            score += np.where(equal, 1, -MISMATCH).astype(np.int32)
            alive = score >= 0
            score *= alive
            matched *= alive
            np.maximum(top, matched, out=top)
        for x in np.argsort(-top, kind="stable").tolist():
            if top[x] < least:
                break
            look(int(own[x]))
    return found


class Benchmark:
    """One block of items, ready to be looked up."""

    def __init__(self, ids: list, texts: pa.Array):
        self.ids = ids
        self.hashes, self.first = tokens(texts)
        self.seeds = []
        for mask in MASKS:
            value, at = window_hashes(self.hashes, self.first, mask)
            order = np.argsort(value, kind="stable")
            self.seeds.append((value[order], at[order]))
        self.item = np.repeat(np.arange(len(ids)), np.diff(self.first))
        sizes = np.diff(self.first)
        self.need = np.array([needed(n) for n in sizes.tolist()], np.int64)
        starts: dict[int, list[int]] = {}
        for start, size in zip(self.first[:-1].tolist(), sizes.tolist(), strict=True):
            for k, n in pieces(size):
                starts.setdefault(n, []).append(start + k)
        self.short = []
        for n, places in sorted(starts.items()):
            value, at = window_hashes(self.hashes, self.first, tuple(range(n)))
            own = np.isin(at, places)
            order = np.argsort(value[own], kind="stable")
            self.short.append((tuple(range(n)), value[own][order], at[own][order]))

    def _equal(self, hashes: np.ndarray, first: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Equal tokens of the whole item on the diagonal, for (text, item, place) rows of short items."""
        t, i, at = key.T
        size, total = self.first[i + 1] - self.first[i], np.zeros(len(key), np.int64)
        for k in range(int(size.max(initial=0))):
            p = at + k
            inside = (k < size) & (p >= first[t]) & (p < first[t + 1])
            total[inside] += hashes[p[inside]] == self.hashes[self.first[i[inside]] + k]
        return total

    def _hits(self, hashes: np.ndarray, first: np.ndarray, mask: tuple[int, ...], value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window of the texts that is among the sorted values: its token, the first equal value, their number."""
        own, place = window_hashes(hashes, first, mask)
        if not len(own) or not len(value):
            return (np.zeros(0, np.int64),) * 3
        low = np.searchsorted(value, own, side="left")
        hit = np.flatnonzero(value[np.minimum(low, len(value) - 1)] == own)
        low = low[hit]
        return place[hit], low, np.searchsorted(value, own[hit], side="right") - low

    def _met(self, text: np.ndarray, place: np.ndarray, low: np.ndarray, count: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Each value that a text has, with each of its places in the benchmark, in portions.

        (text and item packed, place in the benchmark, the text's first window of the value among `sorted`, their
        number, sorted): a value that is often in both isn't multiplied out.
        """
        if not len(place):
            return
        group = text[place] * (len(at) + 1) + low
        order = np.argsort(group, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
        n, own = np.diff(np.append(start, len(order))), order[start]
        for a, b in _portions(count[own]):
            k = np.repeat(np.arange(a, b), count[own[a:b]])
            q = at[_ranges(low[own[a:b]], count[own[a:b]])]
            yield text[place[own[k]]] * len(self.ids) + self.item[q], q, start[k], n[k], place[order]

    def search(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, first token, tokens, equal tokens, tokens of the item) of the best overlap of a text and an item."""
        n_items = len(self.ids)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        hits = [(*self._hits(hashes, first, mask, value), at) for mask, (value, at) in zip(MASKS, self.seeds, strict=True)]
        many = self._many(text, hits, first)
        keys = [np.zeros((0, 2), np.int64)]
        for hit in hits:
            for key, q, start, n, place in self._met(text, *hit):
                if len(many):
                    use = ~np.isin(key, many)
                    key, q, start, n = key[use], q[use], start[use], n[use]
                for a, b in _portions(n):
                    p = place[_ranges(start[a:b], n[a:b])]
                    each = np.repeat(q[a:b], n[a:b])
                    keys.append(np.unique(np.stack([np.repeat(key[a:b], n[a:b]), p - (each - self.first[self.item[each]])], axis=1), axis=0))
        for mask, value, at in self.short:
            place, low, count = self._hits(hashes, first, mask, value)
            for a, b in _portions(count):
                q = at[_ranges(low[a:b], count[a:b])]
                p = np.repeat(place[a:b], count[a:b])
                item = self.item[q]
                key = np.stack([text[p], item, p - (q - self.first[item])], axis=1)
                key = key[self._equal(hashes, first, key) >= self.need[item]]
                keys.append(np.unique(np.stack([key[:, 0] * n_items + key[:, 1], key[:, 2]], axis=1), axis=0))
        rows = np.unique(np.concatenate(keys), axis=0)
        bounds = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0], [True]])) if len(rows) else np.zeros(1, np.int64)
        diagonals = {int(rows[a, 0]): rows[a:b, 1] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)}
        diagonals |= dict.fromkeys(many.tolist())
        found = []
        for key, at in sorted(diagonals.items(), key=lambda x: x[0]):
            t, i = divmod(key, n_items)
            a, b = int(first[t]), int(first[t + 1])
            doc, item = hashes[a:b], self.hashes[self.first[i] : self.first[i + 1]]
            at = np.arange(1 - len(item), b - a) if at is None else at - a
            if (best := most_matched(doc, item, at, int(self.need[i]))) is not None:
                found.append((t, i, *best, len(item)))
        return found

    def _many(self, text: np.ndarray, hits: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], first: np.ndarray) -> np.ndarray:
        """The texts and items, packed, with more hits than are followed one by one."""
        keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
        for hit in hits:
            for key, _, _, n, _ in self._met(text, *hit):
                own, back = np.unique(key, return_inverse=True)
                keys.append(own)
                weights.append(np.bincount(back, n))
        own, back = np.unique(np.concatenate(keys), return_inverse=True)
        if not len(own):
            return own
        t, i = np.divmod(own, len(self.ids))
        return own[np.bincount(back, np.concatenate(weights)) > FEW_HITS * (np.diff(first)[t] + np.diff(self.first)[i])]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) of each."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _portions(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose counts are HELD together at most (a single row may have more)."""
    total, at = np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HELD, side="right")))
        yield at, to
        at = to


def _named(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("item_text"))


def sent(items: DataFrame) -> Benchmark | None:
    """The benchmark, if it is small enough to be sent; only its size is looked up before it is read."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()
    if n > BLOCK_ITEMS or size > BLOCK_BYTES:
        return None
    table = items.toArrow()
    return Benchmark(table.column("item_id").to_pylist(), text_array(table.column("item_text")))


_FOUND = [("start", T.LongType()), ("n_tokens", T.LongType()), ("n_matched", T.LongType()), ("item_tokens", T.LongType())]
_FIELDS = ", ".join(f"{n} long" for n, _ in _FOUND)


def _digest(text: str) -> Column:
    """Equal texts have equal digests."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))


def _windows(rows: DataFrame, of_items: bool, sizes: list[int]) -> DataFrame:
    """(value, key): the distinct window hashes of each text of rows (key, text), each mask's apart from the others'.

    sizes: lengths of the contiguous pieces that short items are found by; of an item only its own pieces are taken.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            for at, to in slices(texts):
                hashes, first = tokens(texts.slice(at, to - at))
                text = np.repeat(np.arange(to - at), np.diff(first))
                values, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                starts = [(t, a + k, n) for t, a, m in zip(range(to - at), first[:-1].tolist(), np.diff(first).tolist(), strict=True) for k, n in pieces(m)] if of_items else []
                for k, mask in enumerate([*MASKS, *(tuple(range(n)) for n in sizes)]):
                    value, place = window_hashes(hashes, first, mask)
                    if of_items and k >= len(MASKS):
                        own = np.isin(place, [a for _, a, n in starts if n == len(mask)])
                        value, place = value[own], place[own]
                    values.append(value ^ (np.uint64(k + 1) * _MIX[0]))
                    owners.append(text[place])
                rows = np.unique(np.stack([np.concatenate(owners), np.concatenate(values).view(np.int64)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), batch.column(0).slice(at, to - at).take(pa.array(rows[:, 0]))], names=["value", "key"])

    return rows.mapInArrow(each, "value long, key binary")


def joined(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_key, start, ...) of the best overlaps, for texts (key, text) and items (item_key, item_text), by shuffles.

    Only pairs that share a window are brought together, and each pair of different texts once.
    """
    distinct_items = items.groupBy("item_key").agg(F.first("item_text").alias("item_text"))
    sizes = list(range(1, len(_MIX)))
    of_items = _windows(distinct_items.select("item_key", "item_text"), True, sizes).withColumnRenamed("key", "item_key")
    hits = _windows(texts.where(F.length("text") > 0), False, sizes).join(of_items, "value").select("key", "item_key").distinct()
    hits = checkpoint(hits)
    wanted = texts.join(hits.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    pairs = hits.join(wanted, "key").join(distinct_items, "item_key").select("key", "item_key", "text", "item_text")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, (text, item) in enumerate(zip(text_array(batch.column(2)), text_array(batch.column(3)), strict=True)):
                for hit in Benchmark([0], pa.array([item.as_py()], pa.large_string())).search(*tokens(pa.array([text.as_py()], pa.large_string()))):
                    rows.append(k)
                    found.append(hit[2:])
            at = pa.array(rows, pa.int64())
            numbers = zip(*found, strict=True) if found else [[]] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int64()) for x in numbers)], names=["key", "item_key", *(n for n, _ in _FOUND)])

    return pairs.mapInArrow(verify, f"key binary, item_key binary, {_FIELDS}")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_tokens, n_matched, item_tokens): the best verified overlap of each document and item that have one."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    items = _named(benchmark, item_id, item_text)
    kind = benchmark.schema[item_id].dataType
    schema = T.StructType([source.schema["doc_id"], T.StructField("item_id", kind), *(T.StructField(n, t) for n, t in _FOUND)])
    block = sent(items)
    if block is None:
        keyed, own = source.withColumn("key", _digest("text")), items.withColumn("item_key", _digest("item_text"))
        found = checkpoint(joined(keyed.select("key", F.coalesce("text", F.lit("")).alias("text")), own))
        return keyed.select("key", "doc_id").join(found, "key").join(own.select("item_key", "item_id"), "item_key").select(*schema.names)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = text_array(batch.column(1))
            for at, to in slices(own):
                hits = block.search(*tokens(own.slice(at, to - at)))
                if hits:
                    rows = batch.column(0).take(pa.array([at + h[0] for h in hits]))
                    items = pa.array([block.ids[h[1]] for h in hits], type=_arrow(kind))
                    yield pa.RecordBatch.from_arrays([rows, items, *(pa.array([h[k] for h in hits], pa.int64()) for k in range(2, 6))], names=schema.names)

    return source.mapInArrow(scan, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def flag(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", to: str = "contaminated") -> DataFrame:
    """docs with a boolean column: whether some overlap with some item was verified."""
    items = _named(benchmark, item_id, item_text)
    block = sent(items)
    if block is None:
        key = free_name(docs, "_digest")
        keyed = docs.withColumn(key, _digest(text))
        own = keyed.select(F.col(key).alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
        found = checkpoint(joined(own, items.select(_digest("item_text").alias("item_key"), "item_text")))
        hit = found.select(F.col("key").alias(key)).distinct().withColumn(to, F.lit(True))
        return keyed.join(hit, key, "left").withColumn(to, F.coalesce(to, F.lit(False))).drop(key)

    def each(texts: pa.Array) -> list[pa.Array]:
        hit = np.zeros(len(texts), bool)
        for h in block.search(*tokens(texts)):
            hit[h[0]] = True
        return [pa.array(hit)]

    return map_texts(docs, text, each, [(to, T.BooleanType())])
