"""Token ids as compressed frames: an adaptive context-mixing range coder over independently reset blocks.

A frame is cut into blocks of BLOCK ids. Every block starts from the same empty model, has its own checksum, and can
be decoded alone; numpy codes all blocks of a frame side by side, one id of each at a time.

Model. The two ids before give an order-2 and an order-1 prediction (the id that last followed there, with a
confidence). The order-2 id is taken if it has been right before, else the order-1 id. The binary event that it is right
has a probability that mixes the block's rates so far by either order's confidence and by both, each weighing as often as it
has been asked, worked out anew at the ids of _MIX. Other ids are coded by the block's order-0
distribution over whole ids, as often as each has come, with a share for those that haven't; such a new id, about which
nothing is known, goes as it is, beside the coded words. The order-0
distributions are worked out anew at the ids of _REBUILD. All arithmetic is on integers, so writer and reader agree to
the bit. The writer knows all ids, so it works the model out for whole blocks (_modelled) and only moves the coder id by id; the
reader has to go id by id (_Model). Ids over 16 bits are coded as two sequences, the low 16 bits and the rest.

Coder. A 48-bit range coder that renormalises by 16-bit words. The share of a miss is cut into 4096 parts, which order-0 shares
are made of; what is above them is the hit's. A word may carry into the one before; carries
stay in the words until the block ends and are settled then.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

MAGIC, WIDE = b"ACM5", b"ACW5"
#: Ids in a block.
BLOCK = 2048
#: Blocks that are coded side by side at most: a step costs its calls, however many blocks it serves. A frame takes some 20 bytes
#: of memory an id while it is coded.
LANES = 4096
#: Slots of an order-1 or order-2 table.
SLOT_BITS = 8
_SLOTS = 1 << SLOT_BITS
_ONE = 1 << 16
_SCALE_BITS = 12
#: Ids after which the order-0 distribution is worked out anew, and after which the prediction's probabilities are.
_REBUILD = (0, 32, 128, 384, 768, 1280)
_MIX = frozenset((16, 32, 48, 64, 96, 128, 192, *range(256, BLOCK, 256)))
_SPAN = 256
#: Blocks whose models are worked out together, so that they stay in the cache.
_GROUP = 32
_M32, _M48 = (1 << 32) - 1, (1 << 48) - 1
_H1, _H2, _H3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0x27D4EB2F)
_HASHES = np.array([[_H1], [_H2], [_H3]])
#: What the confidences of both orders count in a context's number.
_WEIGHTS = np.array([[2], [8]], np.int32)
#: The confidence after a slot's entry, xor the id that came, was 0 to 3 (it was right) or more (it was not).
_HELD = np.array([1, 2, 3, 3, 0], np.int32)
#: Where an id is the predicted one, its order-0 share starts behind all others and has no size.
_AT_HIT = 1 << _SCALE_BITS + 13


class DamagedBlock(ValueError):
    """A block whose bytes don't match its checksum."""


def _chances(asked: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The probability of a hit, of 65536, for each context (the last axis, of 32), from how often each has been asked and right: the
    rates by the order-2 confidence and by the order-1 confidence (each with whether both predict the same id), mixed by how often
    each has been asked."""
    shape = asked.shape
    asked, right = asked.reshape(-1, 4, 4, 2), right.reshape(-1, 4, 4, 2)
    n, hits = 0, 0
    for axis in (2, 1):
        n_own, own = _summed(asked, axis), _summed(right, axis)
        # The rate of n cases weighs n + 2, so the rates' mix is a quotient of sums.
        n, hits = n + 4 * n_own + 8, hits + 4 * own + 1
    n, hits = n + 16 * asked, hits + 16 * right
    return (hits * np.int64(60927) // n + 1).astype(np.int32).reshape(shape)


class _Model:
    """What the reader knows, an id of each lane at a time. Rows of two are of order 1 and of order 2."""

    def __init__(self, lanes: int):
        self.n = lanes
        self.table = np.full(2 * lanes << SLOT_BITS, -4, np.int32)
        self.base = np.arange(2 * lanes).reshape(2, lanes) << SLOT_BITS
        self.last, self.carried = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.at32 = np.arange(lanes, dtype=np.int32) << 5
        self.slot_base = np.arange(lanes) << _SCALE_BITS
        #: For each lane and context: how often the prediction was asked, and right.
        self.asked, self.right = (np.zeros(lanes << 5, np.int32) for _ in range(2))
        #: The contexts since the last mix, and which of their predictions were right.
        self.contexts, self.hits, self.since = np.empty((_SPAN, lanes), np.int32), np.empty((_SPAN, lanes), bool), 0
        self.slots = np.zeros(lanes << _SCALE_BITS, np.uint16)
        self.rebuild(np.zeros((0, lanes), np.int32))
        self.mix()

    def cut(self, n: int) -> None:
        """Only the first n lanes go on."""
        self.n = n
        for k in ("base", "last", "carried", "at32", "slot_base", "first_entry", "contexts", "hits"):
            setattr(self, k, getattr(self, k)[..., :n])

    def mix(self) -> None:
        """The probabilities of a miss anew, of 65536, for each lane and context."""
        if self.since:
            context = self.contexts[: self.since] << 1
            context += self.hits[: self.since]
            counts = np.bincount(context.ravel(), minlength=2 * len(self.asked)).astype(np.int32)
            self.asked += counts[::2]
            self.asked += counts[1::2]
            self.right += counts[1::2]
            self.since = 0
        self.miss = _ONE - _chances(self.asked.reshape(-1, 32), self.right.reshape(-1, 32)).ravel().astype(np.int64)

    def predict(self) -> None:
        """Sets the predicted id, and which share of the 65536 parts other ids have: the order-2 id if it was right before, else the
        order-1 id."""
        i = self.last * _HASHES
        i[1] += self.carried
        self.carried = i[2]
        i = i[:2]
        i >>= np.uint32(32 - SLOT_BITS)
        self.i = i + self.base
        self.e = e = self.table.take(self.i, mode="clip")
        c = e & 3
        self.id = np.where(c[1] > 0, e[1], e[0])
        self.id >>= 2
        c *= _WEIGHTS
        context = self.contexts[self.since]
        np.add(c[0], c[1], out=context)
        context += (e[0] ^ e[1]).view(np.uint32) < 4
        context += self.at32
        self.rest = self.miss.take(context, mode="clip")

    def update(self, x: np.ndarray, hit: np.ndarray) -> None:
        """x: the ids. hit: it is the predicted id."""
        self.hits[self.since] = hit
        self.since += 1
        fresh = x << 2
        self.e ^= fresh
        held = _HELD.take(self.e.view(np.uint32), mode="clip")
        held += fresh
        self.table[self.i] = held
        self.last = x.view(np.uint32)

    def rebuild(self, seen: np.ndarray) -> None:
        """The order-0 distributions anew, from all ids so far (rows by lanes): what each of a lane's 4096 parts stands for, as the place
        among the lane's `entries` of id << 26 | start << 13 | size (-1 for the id of new ones)."""
        t, n, known, count = len(seen), self.n, [], 0
        self.first_entry = np.empty(n, np.int64)
        for k in range(0, n, _GROUP):
            rows = seen[:, k : min(k + _GROUP, n)].T.astype(np.int32, order="C")
            rows.sort(axis=1)
            fresh = np.ones(rows.shape, bool)
            np.not_equal(rows[:, 1:], rows[:, :-1], out=fresh[:, 1:])
            distinct = np.count_nonzero(fresh, axis=1)
            at = np.flatnonzero(fresh)
            size = _sizes(np.diff(at, append=rows.size).astype(np.int32), t, np.repeat(distinct.astype(np.int32), distinct))
            # Behind a lane's ids stands the share of new ones.
            ends = np.cumsum(distinct + 1)
            own = np.ones(len(at) + len(rows), bool)
            own[ends - 1] = False
            sizes = np.zeros(len(own), np.int32)
            sizes[own] = size
            end = np.cumsum(sizes)
            left = (np.arange(1, len(rows) + 1) << _SCALE_BITS) - end[ends - 1]
            left[1:] -= left[:-1].copy()
            sizes[ends - 1] = left
            start = np.cumsum(sizes) - sizes
            start &= (1 << _SCALE_BITS) - 1
            entry = np.full(len(own), -1, np.int64)
            entry[own] = rows.ravel()[at]
            entry <<= 26
            entry |= start << 13
            entry |= sizes
            known.append(entry)
            firsts = ends - distinct - 1
            self.first_entry[k : k + len(rows)] = count + firsts
            number = np.arange(len(own)) - np.repeat(firsts, distinct + 1)
            self.slots[k << _SCALE_BITS : k + len(rows) << _SCALE_BITS] = np.repeat(number.astype(np.uint16), sizes)
            count += len(own)
        self.entries = np.concatenate(known)


def _sizes(count: np.ndarray, t: int, distinct: np.ndarray) -> np.ndarray:
    """How many of the 4096 parts each id has that came `count` times among t ids: one, and a share by its count. The other parts
    are for new ids, which count as often as different ids have come."""
    size = count * ((1 << _SCALE_BITS) - 256 - distinct)
    size //= t + distinct
    size += 1
    return size


def _lanes(n: int) -> tuple[int, int]:
    """Blocks of n ids, and the last block's size."""
    lanes = max(1, -(-n // BLOCK))
    return lanes, n - (lanes - 1) * BLOCK


def _summed(a: np.ndarray, axis: int) -> np.ndarray:
    """a.sum(axis, keepdims=True) of four along the axis, which is quicker than sum where the array is that short there."""
    some = [slice(None)] * a.ndim
    parts = [a[(*some[:axis], slice(k, k + 1))] for k in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def _turned(a: np.ndarray) -> np.ndarray:
    """The transpose, copied in strips that stay in the cache."""
    out = np.empty(a.shape[::-1], a.dtype)
    for k in range(0, a.shape[0], 64):
        out[:, k : k + 64] = a[k : k + 64].T
    return out


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's keys (of 20 bits at most) in order, equal ones in that of their places, and those places; all rows in one."""
    n, t = key.shape
    both = key.astype(np.uint32) << np.uint32(12)
    both |= np.arange(t, dtype=np.uint32)
    both.sort(axis=1)
    return (both >> np.uint32(12)).ravel(), ((both & np.uint32(0xFFF)) + (np.arange(n) * t)[:, None]).ravel()


def _led(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What a table's slot holds before each id (id << 2 | confidence, -4 at first), where key is its slot (lanes by steps).

    A slot holds the last id that came to it, and how often in a row that was right before.
    """
    n, t = x.shape
    slot, order = _sorted(key)
    own = x.ravel()[order]
    first = np.ones(n * t, bool)
    np.not_equal(slot[1:], slot[:-1], out=first[1:])
    first[::t] = True
    again = np.zeros(n * t, bool)
    np.equal(own[1:], own[:-1], out=again[1:])
    again &= ~first
    held = own << 2
    for _ in range(3):
        held += again
        again[1:] &= again[:-1]
    state = np.empty(n * t, np.int32)
    state[1:] = held[:-1]
    state[first] = -4
    out = np.empty(n * t, np.int32)
    out[order] = state
    return out.reshape(n, t)


def _modelled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each id of whole blocks (lanes by steps): the parts of 65536 that other ids than the predicted have, whether it is the
    predicted id, its order-0 share's start and size, and whether that is the share of new ids.

    The writer knows all ids, so it follows each slot of the tables through the block instead of each step.
    """
    n, t = x.shape
    before = np.zeros((n, t + 2), np.uint32)
    before[:, 2:] = x
    last, before = before[:, 1:-1], before[:, :-2]
    shift = np.uint32(32 - SLOT_BITS)
    e1 = _led(x, last * _H1 >> shift)
    e2 = _led(x, before * _H3 + last * _H2 >> shift)
    c1, c2 = e1 & 3, e2 & 3
    hit = np.where(c2 > 0, e2, e1) >> 2 == x
    context = c2 << 3
    context += c1 << 1
    context += (e1 ^ e2).view(np.uint32) < 4
    # Each id's place among the contexts of all spans between two mixes.
    points = sorted(_MIX)
    span = np.searchsorted(points, np.arange(t), side="right")
    spans = len(points) + 1
    context += (np.arange(n)[:, None] * spans + span).astype(np.int32) << 5
    counts = np.bincount(((context << 1) + hit).ravel(), minlength=n * spans * 64).astype(np.int32).reshape(n, spans, 32, 2)
    right = counts[..., 1].copy()
    asked = counts[..., 0] + right
    asked, right = (np.cumsum(c, axis=1, dtype=np.int32) - c for c in (asked, right))
    miss = (_ONE - _chances(asked, right)).astype(np.uint16).ravel().take(context)
    # Each id's number among the block's different ids, by their order.
    by_id, order = _sorted(x)
    fresh = np.zeros((n, t), np.int32)
    np.not_equal(by_id[1:], by_id[:-1], out=fresh.reshape(-1)[1:], casting="unsafe")
    fresh[:, 0] = 0
    fresh = np.cumsum(fresh, axis=1, dtype=np.int32)
    width = int(fresh[:, -1].max()) + 1
    number = np.empty(n * t, np.int64)
    number[order] = (fresh + (np.arange(n, dtype=np.int32) * width)[:, None]).ravel()
    number = number.reshape(n, t)
    start, size, new = np.empty((n, t), np.uint16), np.empty((n, t), np.uint16), np.empty((n, t), bool)
    count = np.zeros((n, width), np.int32)
    for a, b in zip(_REBUILD, (*_REBUILD[1:], t), strict=True):
        here = number[:, a:b].ravel()
        seen = count > 0
        share = _sizes(count, a, np.count_nonzero(seen, axis=1).astype(np.int32)[:, None]) if a else count.copy()
        share *= seen
        end = np.cumsum(share, axis=1, dtype=np.int32)
        new_start = end[:, -1:].copy()
        end -= share
        share <<= 13
        share |= end
        # The share of new ids is behind all others.
        np.copyto(share, 1 << 26 | (1 << _SCALE_BITS) - new_start << 13 | new_start, where=~seen)
        both = share.ravel().take(here).reshape(n, -1)
        start[:, a:b], size[:, a:b], new[:, a:b] = both & 0x1FFF, both >> 13 & 0x1FFF, both >> 26
        count += np.bincount(here, minlength=n * width).reshape(n, width).astype(np.int32)
    return miss, hit, start, size, new & ~hit


def _encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Words and verbatim bytes of each block."""
    n = len(ids)
    lanes, tail = _lanes(n)
    padded = np.zeros((lanes, BLOCK), np.uint16)
    padded.reshape(-1)[:n] = ids
    rest, start, size = (np.empty((BLOCK, lanes), np.uint16) for _ in range(3))
    hits = np.empty((BLOCK, lanes), bool)
    raw: list[bytes] = []
    for k in range(0, lanes, _GROUP):
        some = slice(k, k + _GROUP)
        miss, hit, first, parts, new = _modelled(padded[some].astype(np.int32))
        if k + _GROUP >= lanes:
            new[-1, tail:] = False
        # A hit lies behind all order-0 shares.
        first[hit] = 1 << _SCALE_BITS
        rest[:, some], hits[:, some], start[:, some], size[:, some] = miss.T, hit.T, first.T, parts.T
        bare, ends = padded[some][new].astype("<u2").tobytes(), (2 * np.cumsum(np.count_nonzero(new, axis=1))).tolist()
        raw += [bare[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    del padded
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, _M48, np.int64)
    words = np.zeros((lanes, BLOCK + 4), np.int32)  # pages that aren't needed aren't touched
    flat = words.reshape(-1)
    first_word = np.arange(lanes) * (BLOCK + 4)
    pos = first_word.copy()
    all_low, all_pos = low, pos
    m = lanes
    for t in range(BLOCK if lanes > 1 else tail):
        if t == tail and m == lanes:
            m = lanes - 1
            low, rng, pos = low[:-1], rng[:-1], pos[:-1]
        part = rng >> 16
        part *= rest[t, :m]
        part >>= _SCALE_BITS
        before = part * start[t, :m]
        low += before
        part *= size[t, :m]
        rng -= before
        rng = np.where(hits[t, :m], rng, part)
        # All lanes write; what a lane that isn't short writes is written over by its next word.
        flat[pos] = (low >> 32).astype(np.int32)
        short = (rng <= _M32).astype(np.int64)
        shift = short << 4
        rng <<= shift
        keep = short - 1
        keep |= _M32
        low &= keep
        low <<= shift
        pos += short
    for shift in (32, 16, 0):
        flat[all_pos] = (all_low >> shift) & (0xFFFF if shift < 32 else 0x1FFFF)
        all_pos += 1
    n_words = all_pos - first_word
    words = words[:, : int(n_words.max())]
    words[np.arange(words.shape[1]) >= n_words[:, None]] = 0
    while True:
        lane, over = np.nonzero(words > 0xFFFF)
        if not len(lane):
            break
        carry = words[lane, over] >> 16
        words[lane, over] &= 0xFFFF
        words[lane, over - 1] += carry
    of_words = words.astype("<u2")
    return [of_words[i, :k].tobytes() for i, k in enumerate(n_words.tolist())], raw


def _decode(n: int, words: list[bytes], raw: list[bytes]) -> np.ndarray:
    lanes, tail = _lanes(n)
    depth = max(len(w) // 2 for w in words) + 4
    by_row = np.zeros((lanes, depth), np.uint16)
    raw_row = np.zeros((lanes, max(map(len, raw), default=0) // 2 + 1), np.uint16)
    for i, (w, r) in enumerate(zip(words, raw, strict=True)):
        by_row[i, : len(w) // 2] = np.frombuffer(w, "<u2")
        raw_row[i, : len(r) // 2] = np.frombuffer(r, "<u2")
    flat, raw_flat = by_row.reshape(-1), raw_row.reshape(-1)
    m = _Model(lanes)
    pos, raws = np.arange(lanes) * depth, np.arange(lanes) * raw_row.shape[1]
    code = np.zeros(lanes, np.int64)
    for _ in range(3):
        code = code << 16 | flat[pos]
        pos += 1
    rng = np.full(lanes, _M48, np.int64)
    out = np.zeros((BLOCK, lanes), np.uint16)
    for t in range(BLOCK if lanes > 1 else tail):
        if t == tail and m.n == lanes:
            m.cut(lanes - 1)
            code, rng, pos, raws = code[:-1], rng[:-1], pos[:-1], raws[:-1]
        if t in _REBUILD and t:
            m.rebuild(out[:t])
        if t in _MIX:
            m.mix()
        m.predict()
        part = rng >> 16
        part *= m.rest
        part >>= _SCALE_BITS
        quotient = code / part  # under 2**17, of 48-bit integers: its whole part is exact
        hit = quotient >= 1 << _SCALE_BITS
        slot = quotient.astype(np.int64)
        # For lanes that predict the id, the slot is any; it is not used.
        slot &= (1 << _SCALE_BITS) - 1
        slot += m.slot_base
        place = m.slots.take(slot, mode="clip") + m.first_entry
        entry = np.where(hit, _AT_HIT, m.entries.take(place, mode="clip"))
        x = np.where(hit, m.id, (entry >> 26).astype(np.int32))
        new = entry < 0
        x = np.where(new, raw_flat.take(raws, mode="clip"), x)
        raws += new
        start = entry >> 13
        start &= 0x1FFF
        start *= part
        code -= start
        rng -= start
        entry &= 0x1FFF
        part *= entry
        rng = np.where(hit, rng, part)
        short = (rng <= _M32).astype(np.int64)
        shift = short << 4
        rng <<= shift
        code <<= shift
        np.negative(short, out=shift)
        shift &= flat.take(pos, mode="clip")
        code |= shift
        pos += short
        out[t, : m.n] = x
        m.update(x, hit)
    return _turned(out).reshape(-1)[:n]


def encode_frame(ids: np.ndarray) -> bytes:
    """Magic, number of ids, then for each block its words' and verbatim bytes' lengths and their checksum; then the bytes.

    Where an id has over 16 bits: another magic, the length of the low 16 bits' frame, that frame, and the rest's frame.
    """
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> 32):
        raise ValueError("ids have to lie in 0..2**32 - 1")
    if len(ids) and int(ids.max()) > 0xFFFF:
        wide = np.asarray(ids, np.int64)
        low = encode_frame(wide & 0xFFFF)
        return b"".join([WIDE, np.array([len(low)], "<u8").tobytes(), low, encode_frame(wide >> 16)])
    words, raw = _encode(np.asarray(ids)) if len(ids) else ([], [])
    table = np.array([(len(w), len(r), zlib.crc32(r, zlib.crc32(w))) for w, r in zip(words, raw, strict=True)], "<u4").reshape(-1, 3)
    return b"".join([MAGIC, np.array([len(ids)], "<u8").tobytes(), table.tobytes(), *(x for pair in zip(words, raw, strict=True) for x in pair)])


def _halves(data: bytes) -> tuple[bytes, bytes]:
    size = int(np.frombuffer(data, "<u8", 1, 4)[0])
    return data[12 : 12 + size], data[12 + size :]


@dataclass
class Frame:
    n: int
    words: list[bytes]
    raw: list[bytes]


def read_frame(data: bytes) -> Frame:
    """Splits a frame into blocks and holds each against its checksum."""
    if data[:4] != MAGIC:
        raise DamagedBlock("not a frame")
    n = int(np.frombuffer(data, "<u8", 1, 4)[0])
    lanes = -(-n // BLOCK)
    table = np.frombuffer(data, "<u4", 3 * lanes, 12).reshape(-1, 3)
    at, words, raw = 12 + 12 * lanes, [], []
    for k, (a, b, crc) in enumerate(table.tolist()):
        w, r = data[at : at + a], data[at + a : at + a + b]
        if len(w) != a or len(r) != b or zlib.crc32(r, zlib.crc32(w)) != crc:
            raise DamagedBlock(f"block {k} doesn't match its checksum")
        words.append(w)
        raw.append(r)
        at += a + b
    return Frame(n, words, raw)


def decode_frame(data: bytes) -> np.ndarray:
    if data[:4] == WIDE:
        low, high = map(decode_frame, _halves(data))
        return low | high.astype(np.int64) << 16
    f = read_frame(data)
    if not f.n:
        return np.zeros(0, np.int32)
    return _decode(f.n, f.words, f.raw)


def decode_block(data: bytes, block: int) -> np.ndarray:
    """One block of a frame alone."""
    if data[:4] == WIDE:
        low, high = (decode_block(x, block) for x in _halves(data))
        return low | high.astype(np.int64) << 16
    f = read_frame(data)
    size = _lanes(f.n)[1] if block == len(f.words) - 1 else BLOCK
    return _decode(size, [f.words[block]], [f.raw[block]])
