"""Removal of long strings that an earlier document has too, by suffix sorting with bucket-pointer refinement.

A byte goes if a MATCH-byte string over it also starts in a document with a smaller id. Sorting all suffixes of a
corpus in one place is out of the question, so suffixes are dealt out by their q-gram buckets:

1. In each text, anchors are picked: of every MATCH-byte string, the GRAM-byte string with the smallest hash (all of
   equal ones). The choice depends on the string alone, so equal strings have equal anchors at equal places.
2. Anchors are brought together by their hash; those of a single document can't lie in a repeated string and go.
3. What is around the remaining anchors (the strings of MATCH bytes over the anchor) is brought together by bucket;
   equal surroundings are merged before and after they move. In each bucket the suffixes of the surroundings are
   sorted: 8-byte buckets first; buckets of several suffixes are refined by the bucket pointers of the suffixes 8, 16
   and 18 bytes on, which are updated in place and reused by the passes after, until MATCH bytes are told apart. Each
   bucket of equal strings then knows its smallest document.
4. The strings that have a smaller document are brought back to their texts, which are cut.

Rows that move are packed, compressed arrays. Texts are dealt out once, by a hash of the document; steps 3 and 4 read
the same exchange. A passage that many documents share costs each task that meets it one row.

Defined results: a null or empty text has no byte. A null id counts as larger than all others. Rows with equal ids are
one document to each other: they never remove each other's bytes; so are all rows with a null id. Repeated rows each get
a row. Matches never cross rows. Ids lie below 2 ** 62. An empty table gives an empty table. Other columns of the input,
whatever their names, don't take part.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import sha256_hex, slices, text_array, text_buffers

MATCH, GRAM = 50, 20
#: Bytes before an anchor that its strings can reach.
LEFT = MATCH - GRAM
WIDTH = LEFT + MATCH
#: Anchors that a task holds before it hands them on.
HELD = 2_000_000
#: Text bytes that a task holds before it hands them on.
HELD_BYTES = 24 << 20
#: Buckets a partition.
SPREAD = 2
#: Rows without an id get numbers from here on, by their text; as documents they are all this one.
NO_ID = 1 << 62
LAST = (1 << 63) - 1
#: Bits of an anchor's hash that go on. Two anchors that only seem equal are told apart later, by their bytes.
KEY_BITS = 40

_C1, _C2, _C3, _C4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))
_U32 = np.uint64(32)


# --- packed arrays ---


def pack(*arrays: np.ndarray) -> bytes:
    """One-dimensional arrays as bytes: types, lengths, then each array's bytes by significance, compressed."""
    head = [struct.pack("<B", len(arrays))]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<3sq", a.dtype.str.encode(), len(a)))
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return b"".join(head) + zstandard.ZstdCompressor(level=3).compress(b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    n, at = data[0], 1
    kinds = []
    for _ in range(n):
        kinds.append(struct.unpack_from("<3sq", data, at))
        at += 11
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at:]), np.uint8)
    out, at = [], 0
    for name, size in kinds:
        kind = np.dtype(name.decode())
        end = at + size * kind.itemsize
        out.append(np.ascontiguousarray(body[at:end].reshape(kind.itemsize, size).T).view(kind).reshape(size))
        at = end
    return out


# --- anchors ---


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 8 and 4 bytes from each place on as numbers (missing bytes: zero)."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    x[:-1] |= x[1:] << np.uint64(8)
    four = x.copy()
    four[:-2] = (x[:-2] & np.uint64(0xFFFF)) | ((x[2:] & np.uint64(0xFFFF)) << np.uint64(16))
    eight = four.copy()
    eight[:-4] |= four[4:] << _U32
    return eight[: len(data)], four[: len(data)]


def gram_hash(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on; garbage where fewer are left."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight, four = _grams(data)
    h = eight[:n] * _C1
    h ^= h >> np.uint64(29)
    h += eight[8 : 8 + n] * _C2
    h ^= h >> np.uint64(31)
    h += four[16 : 16 + n] * _C3
    h ^= h >> _U32
    h *= _C4
    return h


def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    """best over a[i:i+width] for each i that has as many; by doubling."""
    size = 1
    while 2 * size <= width:
        a = best(a[: len(a) - size], a[size:])
        size *= 2
    rest = width - size
    return best(a[: len(a) - rest], a[rest:]) if rest else a


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in all texts, and their hashes."""
    full = gram_hash(data)
    n, windows = len(full), MATCH - GRAM + 1
    if n < windows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = (full >> _U32).astype(np.uint32) | np.uint32(1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    place = np.arange(n)
    h[place > ends - GRAM] = 0xFFFFFFFF
    low = _slide(h, windows, np.minimum)
    low[place[: len(low)] > ends[: len(low)] - MATCH] = 0
    padded = np.zeros(len(low) + 2 * (windows - 1), np.uint32)
    padded[windows - 1 : windows - 1 + len(low)] = low
    # A place is an anchor if it has the smallest hash of some string over it.
    top = _slide(padded, windows, np.maximum)
    at = np.flatnonzero((top[:n] == h) & (place <= ends - GRAM))
    return at, full[at]


# --- surroundings ---


def surroundings(data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """WIDTH bytes around each anchor, zero outside its text, and two bytes: how many there are on the left, on the right."""
    left = np.minimum(at - start, LEFT)
    right = np.minimum(end - at, MATCH)
    cols = np.arange(-LEFT, MATCH)
    place = at[:, None] + cols
    inside = (cols >= -left[:, None]) & (cols < right[:, None])
    out = np.zeros((len(at), WIDTH + 2), np.uint8)
    out[:, :WIDTH] = np.where(inside, data[np.clip(place, 0, max(0, len(data) - 1))], 0)
    out[:, WIDTH], out[:, WIDTH + 1] = left, right
    return out


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of distinct rows (2-d bytes), and each row's number among them."""
    n, width = rows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    lanes = padded.view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(lanes.shape[1]):
        h = (h ^ lanes[:, k]) * _C1
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not (lanes[order[1:][same]] == lanes[order[:-1][same]]).all():  # two rows with one hash: compare bytes
        first, number = np.unique(rows.view(f"V{width}").ravel(), return_index=True, return_inverse=True)[1:]
        return first, number.ravel()
    group = np.concatenate([[0], np.cumsum(~same)])
    number = np.empty(n, np.int64)
    number[order] = group
    return order[np.concatenate([[True], ~same])], number


def refine(pointers: np.ndarray, members: np.ndarray, step: int) -> np.ndarray:
    """Sorts the members of unresolved buckets by the bucket pointers of the suffixes `step` on; returns those still unresolved.

    A pointer is the place of the bucket's first suffix in suffix order. Each part that a bucket falls into gets the
    place of its own first suffix, in place, so later passes reuse it, and buckets that aren't touched keep theirs.
    """
    own, later = pointers[members], pointers[members + step]
    order = np.lexsort((later, own))
    own, later = own[order], later[order]
    fresh = np.concatenate([[True], own[1:] != own[:-1]])
    part = fresh | np.concatenate([[True], later[1:] != later[:-1]])
    at = np.arange(len(order))
    bucket = np.maximum.accumulate(np.where(fresh, at, 0))
    first = np.maximum.accumulate(np.where(part, at, 0))
    pointers[members[order]] = own + (first - bucket)
    size = np.diff(np.append(np.flatnonzero(part), len(order)))
    return members[order[np.repeat(size > 1, size)]]


def suffix_buckets(rows: np.ndarray) -> np.ndarray:
    """For each row and each of its strings of MATCH bytes, the pointer of its bucket of equal strings.

    Buckets of 8-byte grams come first. A bucket of one suffix is resolved and never sorted again; of the others, only
    suffixes that the next pass reads are refined: 8 bytes on, then 16 (both by pointers of that depth), then as many as
    are left of MATCH.
    """
    n, width = len(rows), WIDTH - 7
    flat = np.zeros((n, WIDTH), np.uint64)
    flat[:] = rows[:, :WIDTH]
    eight = np.zeros((n, width), np.uint64)
    for k in range(8):
        eight |= flat[:, k : k + width] << np.uint64(8 * k)
    order = np.argsort(eight, axis=None, kind="stable")
    grams = eight.ravel()[order]
    start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    size = np.diff(np.append(start, len(order)))
    pointers = np.empty(n * width, np.int64)
    pointers[order] = np.repeat(start, size)
    unresolved, last = order[np.repeat(size > 1, size)], width
    for step in (8, 16, MATCH - 32):
        last -= step
        unresolved = unresolved[unresolved % width < last]
        if len(unresolved):
            unresolved = refine(pointers, unresolved, step)
    return pointers.reshape(n, width)[:, : LEFT + 1]


def smallest(keys: np.ndarray, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each distinct surrounding and each of its strings, the smallest document that has the string.

    keys: the anchors' hashes; docs: each surrounding's smallest document. Only surroundings that share an anchor
    with others need sorting. Strings that reach beyond their text get LAST.
    """
    out = np.repeat(docs[:, None], LEFT + 1, axis=1)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    same[1:] |= k[1:] == k[:-1]
    same[:-1] |= k[1:] == k[:-1]
    several = order[same]
    valid = _valid(rows)
    step = 1 << 15
    at = 0
    while at < len(several):
        to = min(at + step, len(several))
        while to < len(several) and keys[several[to]] == keys[several[to - 1]]:
            to += 1
        part = several[at:to]
        buckets = suffix_buckets(rows[part])
        flat, ok = buckets.ravel(), valid[part].ravel()
        least = np.full(int(flat.max()) + 1, LAST)
        np.minimum.at(least, flat[ok], np.repeat(docs[part], LEFT + 1)[ok])
        out[part] = least[buckets]
        at = to
    out[~valid] = LAST
    return out


def _valid(rows: np.ndarray) -> np.ndarray:
    """Which of a surrounding's strings lie in its text."""
    o = np.arange(LEFT + 1)
    left, right = rows[:, WIDTH].astype(np.int64)[:, None], rows[:, WIDTH + 1].astype(np.int64)[:, None]
    return (o >= LEFT - left) & (o + GRAM <= right)


# --- the distributed steps ---

_BLOB = "bucket long, blob binary"
_BLOB_ARROW = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])


def home_of(ids: np.ndarray, m: int) -> np.ndarray:
    """pmod(xxhash64(id), m) as Spark has it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, k: int) -> np.ndarray:
        return (x << np.uint64(k)) | (x >> np.uint64(64 - k))

    with np.errstate(over="ignore"):
        h = np.full(len(ids), np.uint64(42 + 8) + p5, np.uint64)
        h ^= turn(ids.view(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> _U32
    return h.view(np.int64) % m


def _document(ids: np.ndarray) -> np.ndarray:
    return np.minimum(ids, NO_ID)


class _Outbox:
    """Collects rows of parallel arrays by bucket (the first array), and packs them."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def put(self, *arrays: np.ndarray) -> None:
        if len(arrays[0]):
            self.parts.append(arrays)
            self.size += len(arrays[0])

    def send(self) -> Iterator[pa.RecordBatch]:
        """A row for each bucket; its arrays are sorted by the first of them, which goes as differences."""
        if not self.parts:
            return
        arrays = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        order = np.lexsort((arrays[1], arrays[0]))
        arrays = [a[order] for a in arrays]
        bounds = np.flatnonzero(np.concatenate([[True], arrays[0][1:] != arrays[0][:-1], [True]]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = [x[a:b] for x in arrays[1:]]
            own[0] = np.concatenate([own[0][:1], np.diff(own[0])])
            yield _row(int(arrays[0][a]), pack(*own))


def _row(bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": [bucket], "blob": [blob]}, _BLOB_ARROW)


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of each bucket; rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != now and held:
                yield held
                held = []
            now = b
            held.append(blob.as_py())
    if held:
        yield held


def _together(blobs: Iterable[bytes]) -> list[np.ndarray]:
    """The arrays of blobs that an outbox has sent."""
    parts = [unpack(x) for x in blobs]
    for p in parts:
        p[0] = np.cumsum(p[0], dtype=p[0].dtype)
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _dealt(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "bucket").sortWithinPartitions("bucket")


class _Bucket:
    """The distinct (id, text) rows of a bucket, by id."""

    def __init__(self, table: pa.Table):
        ids, sizes, raw = [], [], []
        for x in table.column("blob"):
            i, n, data = unpack(x.as_py())
            ids.append(i)
            sizes.append(n)
            raw.append(data)
        all_ids, all_sizes = np.concatenate(ids), np.concatenate(sizes).astype(np.int64)
        data = np.concatenate(raw)
        ends = np.cumsum(all_sizes)
        order = np.argsort(all_ids, kind="stable")
        again = np.flatnonzero(np.diff(all_ids[order]) == 0)
        self.copies = np.ones(len(order), np.int64)
        if len(again):  # rows of one id: by text, equal ones once
            texts = [data[e - n : e].tobytes() for e, n in zip(ends.tolist(), all_sizes.tolist(), strict=True)]
            count: dict[tuple[int, bytes], list[int]] = {}
            for k in order.tolist():
                count.setdefault((int(all_ids[k]), texts[k]), []).append(k)
            keys = sorted(count)
            order = np.array([count[k][0] for k in keys])
            self.copies = np.array([len(count[k]) for k in keys])
        self.ids = all_ids[order]
        size = all_sizes[order]
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        self.data = data[np.repeat(ends[order] - size - self.offsets[:-1], size) + np.arange(self.offsets[-1])]
        self.first = np.searchsorted(self.ids, self.ids, side="left")

    def place(self, ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The row that is the nth of its id."""
        return np.searchsorted(self.ids, ids, side="left") + nth


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row; with_text: also what is left, as `kept` (binary)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = n * SPREAD
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    number = F.coalesce("doc_id", F.lit(NO_ID) + F.xxhash64("text").bitwiseAND(F.lit((1 << 60) - 1)))
    long_enough = named.where(F.octet_length("text") >= MATCH).select(number.alias("doc_id"), "text")
    drop_bits = np.uint64(64 - KEY_BITS)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox()
        for batch in batches:
            texts, ids = text_array(batch.column(1)), batch.column(0).to_numpy()
            for a, b in slices(texts):
                offsets, raw = text_buffers(texts.slice(a, b - a))
                at, key = anchors(np.frombuffer(raw, np.uint8), offsets)
                doc = np.searchsorted(offsets, at, side="right") - 1
                key >>= drop_bits
                box.put((key % np.uint64(m)).astype(np.int64), key, ids[a + doc], (at - offsets[doc]).astype(np.uint32))
                if box.size >= HELD:
                    yield from box.send()
        yield from box.send()

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox()
        for blobs in _by_bucket(batches):
            key, ids, at = _together(blobs)
            order = np.argsort(key, kind="stable")
            k, d = key[order], _document(ids)[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            some = order[np.repeat(several, np.diff(np.append(first, len(k))))]
            box.put(home_of(ids[some], m), ids[some], at[some])
            if box.size >= HELD:
                yield from box.send()
        yield from box.send()

    def pack_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([h[0] for h in held])
            texts = pa.concat_arrays([h[1] for h in held])
            home = home_of(ids, m)
            order = np.argsort(home, kind="stable")
            ids, home, texts = ids[order], home[order], texts.take(pa.array(order))
            offsets, raw = text_buffers(texts)
            data = np.frombuffer(raw, np.uint8)
            bounds = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield _row(int(home[a]), pack(ids[a:b], np.diff(offsets[a : b + 1]).astype(np.uint32), data[offsets[a] : offsets[b]]))

        for batch in batches:
            texts, ids = text_array(batch.column(1)), batch.column(0).to_numpy()
            for a, b in slices(texts):
                held.append((ids[a:b], texts.slice(a, b - a)))
                size += int(text_buffers(held[-1][1])[0][-1])
                if size >= HELD_BYTES:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    found = _dealt(long_enough.mapInArrow(find, _BLOB), n).mapInArrow(shared, _BLOB)
    texts = long_enough.mapInArrow(pack_texts, _BLOB).repartition(n, "bucket")

    def surround(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        if left.num_rows and right.num_rows:
            own = _Bucket(left)
            ids, at = _together(x.as_py() for x in right.column("blob"))
            # Of several rows with the id, all are looked at; only the bytes that are there count.
            low, high = (np.searchsorted(own.ids, ids, side=x) for x in ("left", "right"))
            count = high - low
            row = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            at = np.repeat(at, count).astype(np.int64)
            fits = at + GRAM <= own.offsets[row + 1] - own.offsets[row]
            row, at = row[fits], at[fits]
            for a in range(0, len(at), 1 << 18):
                r, p = row[a : a + (1 << 18)], at[a : a + (1 << 18)]
                start, end = own.offsets[r], own.offsets[r + 1]
                around = surroundings(own.data, start + p, start, end)
                u, which = distinct(around)
                key = gram_hash(np.ascontiguousarray(around[u, LEFT : LEFT + GRAM]).ravel())[::GRAM] >> drop_bits
                rows += _packed_surroundings(key, around[u], which, own.ids[r], (r - own.first[r]).astype(np.uint32), p.astype(np.uint32), m)
        return pa.Table.from_pydict({"bucket": [r[0] for r in rows], "blob": [r[1] for r in rows]}, _BLOB_ARROW)

    around = _dealt(texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(surround, _BLOB), n)

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox()
        for blobs in _by_bucket(batches):
            parts, n_rows = [], 0
            for blob in blobs:
                key, flat, doc, which, ids, nth, at = unpack(blob)
                parts.append((key, flat.reshape(len(key), WIDTH + 2), doc, which.astype(np.int64) + n_rows, ids, nth, at))
                n_rows += len(key)
            key, rows, doc, which, ids, nth, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            u, again = distinct(rows)
            least = np.full(len(u), LAST)
            np.minimum.at(least, again, doc)
            small = smallest(key[u], rows[u], least)
            mine = again[which]
            for a in range(0, len(mine), 1 << 18):
                s = slice(a, a + (1 << 18))
                earlier = small[mine[s]] < _document(ids[s])[:, None]
                bits = (earlier.astype(np.uint32) << np.arange(LEFT + 1, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
                hit = np.flatnonzero(bits)
                box.put(home_of(ids[s][hit], m), ids[s][hit], nth[s][hit], at[s][hit], bits[hit])
                if box.size >= HELD:
                    yield from box.send()
        yield from box.send()

    marks = around.mapInArrow(sort, _BLOB)
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            own = _Bucket(left)
            change = np.zeros(len(own.data) + 1, np.int64)
            if right.num_rows:
                ids, nth, at, bits = _together(x.as_py() for x in right.column("blob"))
                place = own.offsets[own.place(ids, nth)] + at - LEFT
                which, o = np.nonzero((bits[:, None] >> np.arange(LEFT + 1, dtype=np.uint32)) & 1)
                begins = np.zeros(len(own.data) + 1, bool)
                begins[place[which] + o] = True
                begins = np.flatnonzero(begins)
                change[begins] += 1
                change[begins + MATCH] -= 1
            covered = np.cumsum(change[:-1]) > 0
            for k, (i, copies) in enumerate(zip(own.ids.tolist(), own.copies.tolist(), strict=True)):
                a, b = int(own.offsets[k]), int(own.offsets[k + 1])
                gone = covered[a:b]
                kept = own.data[a:b][~gone].tobytes()
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                rows += [(i if i < NO_ID else None, b - a, int(gone.sum()), spans, sha256_hex(kept), *([kept] if with_text else []))] * copies
        return _table(rows, with_text)

    cut_texts = texts.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(cut, fields)

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, len(t), 0, 0, sha256_hex(t), *([t] if with_text else [])) for i, t in zip(batch.column(0).to_pylist(), (x.as_py().encode() for x in batch.column(1)), strict=True)]
            yield from _table(rows, with_text).to_batches()

    return cut_texts.unionAll(named.where(F.octet_length("text") < MATCH).mapInArrow(short, fields))


def _table(rows: list[tuple], with_text: bool) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])])
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _packed_surroundings(key: np.ndarray, rows: np.ndarray, which: np.ndarray, ids: np.ndarray, nth: np.ndarray, at: np.ndarray, m: int) -> Iterator[tuple[int, bytes]]:
    """Distinct surroundings with their members, by the anchor's bucket."""
    least = np.full(len(rows), LAST)
    np.minimum.at(least, which, _document(ids))
    bucket = (key % np.uint64(m)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    member = np.argsort(place[which], kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], bucket[by][1:] != bucket[by][:-1]]))
    ends = np.append(starts[1:], len(by))
    m_place = place[which[member]]
    for a, b, c, d in zip(starts.tolist(), ends.tolist(), np.searchsorted(m_place, starts).tolist(), np.searchsorted(m_place, ends).tolist(), strict=True):
        own, mine = by[a:b], member[c:d]
        yield int(bucket[own[0]]), pack(key[own], rows[own].ravel(), least[own], (m_place[c:d] - a).astype(np.uint32), ids[mine], nth[mine], at[mine])
