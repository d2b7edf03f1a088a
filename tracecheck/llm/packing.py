"""Hierarchical packing of token sequences of several lengths.

A document's ids and an end id are routed by their number to context-size tiers: whole windows of the longest tier are
cut off first, and what is left goes to the shortest tier that it fits in. The tiers are packed from the longest down.
Each window opens with the largest piece of its tier; gaps are filled with the largest shorter pieces that fit, and
what then remains is filled with the head of the smallest piece that is longer, whose rest is routed again. So each
window ends up full, and sequences of a tier's length need no padding. Windows are dealt to step groups of about equal
numbers of ids, tier by tier, each to the group that has least.

Tasks pack their own documents, in blocks of a bounded number of ids; the one window that a block may leave unfilled
goes on in the next block. At the end of a task its pieces are closed as windows of powers of two, the shortest
tiers of all. Nothing is shuffled, and a task that runs again gives the same rows.

Defined results: a null or empty text is a document of the end id alone. Each row is a document, also where an id
repeats or is null; its pieces carry the id as it is. A text of any length is packed whole. An empty table gives an
empty table. Other columns of the input, whatever their names, don't take part.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .idfile import Encoder
from .kit import slices, text_array

#: Context sizes, shortest first; each is a power of two.
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Ids packed at once, at least (a longer document is a block of its own), and ids of a step group, at about.
BLOCK_IDS, STEP_IDS = 1 << 20, 1 << 15


@dataclass(frozen=True)
class Placed:
    """A document's ids from start to start + size, at an offset of a window."""

    doc: int
    start: int
    size: int
    offset: int


class Shelves:
    """Pieces (document, start) by their size; a bit for each size that there are pieces of."""

    def __init__(self, longest: int):
        self.held: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.bits = 0

    def put(self, size: int, doc: int, start: int) -> None:
        self.held[size].append((doc, start))
        self.bits |= 1 << size

    def take(self, size: int) -> tuple[int, int]:
        doc, start = self.held[size].pop()
        if not self.held[size]:
            self.bits ^= 1 << size
        return doc, start

    def largest(self, up_to: int) -> int:
        """The largest size of a piece of at most up_to ids; 0 if there is none."""
        return max(0, (self.bits & ((2 << up_to) - 1)).bit_length() - 1)

    def smallest(self, above: int) -> int:
        """The smallest size of a piece of over `above` ids; 0 if there is none."""
        rest = self.bits >> (above + 1)
        return above + (rest & -rest).bit_length() if rest else 0


def pack(sizes: Sequence[tuple[int, int]], tiers: Sequence[int] = TIERS) -> tuple[list[list[Placed]], list[Placed]]:
    """Full windows of documents' pieces, and what is left over: pieces that fill less than a window.

    sizes: each document's first id to pack and the number of its ids.
    """
    longest, shelves, windows = tiers[-1], Shelves(tiers[-1]), []
    for doc, (start, size) in enumerate(sizes):
        whole = size // longest
        windows += [[Placed(doc, start + k * longest, longest, 0)] for k in range(whole)]
        if size % longest:
            shelves.put(size % longest, doc, start + whole * longest)
    for k in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[k], tiers[k - 1] if k else 0
        while (size := shelves.largest(tier)) > below:
            doc, start = shelves.take(size)
            window, at = [Placed(doc, start, size, 0)], size
            while gap := tier - at:
                size = shelves.largest(gap)
                if size:
                    doc, start = shelves.take(size)
                elif size := shelves.smallest(gap):
                    doc, start = shelves.take(size)
                    shelves.put(size - gap, doc, start + gap)
                    size = gap
                else:
                    return windows, window  # all pieces are in windows
                window.append(Placed(doc, start, size, at))
                at += size
            windows.append(window)
    return windows, []


def closed(pieces: Sequence[Placed]) -> list[list[Placed]]:
    """The pieces as windows whose sizes are different powers of two, the largest first."""
    total, windows, queue = sum(p.size for p in pieces), [], list(pieces)[::-1]
    for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
        window, at = [], 0
        while at < size:
            p = queue.pop()
            own = min(p.size, size - at)
            window.append(Placed(p.doc, p.start, own, at))
            if own < p.size:
                queue.append(Placed(p.doc, p.start + own, p.size - own, 0))
            at += own
        windows.append(window)
    return windows


def step_groups(sizes: Sequence[int], step: int = STEP_IDS) -> list[int]:
    """A step group for each window: the largest first, each to the group with the least ids so far."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step)))]
    found = [0] * len(sizes)
    for w in sorted(range(len(sizes)), key=lambda w: -sizes[w]):
        load, group = heapq.heappop(groups)
        found[w] = group
        heapq.heappush(groups, (load + sizes[w], group))
    return found


@dataclass
class Packer:
    """Packs a task's documents block by block."""

    part: int
    tiers: Sequence[int] = TIERS
    sequences: int = 0
    steps: int = 0
    #: Documents of the block: id, ids from which on they are held, the ids, the number of all ids of the document.
    docs: list[tuple[int | None, int, np.ndarray, int]] = field(default_factory=list)
    waiting: int = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.waiting += len(ids)

    def block(self, last: bool) -> pa.RecordBatch:
        windows, left = pack([(start, len(ids)) for _, start, ids, _ in self.docs], self.tiers)
        if last:
            windows, left = windows + closed(left), []
        base, step = self.part << 33, (self.part << 33) + self.steps
        sizes = [w[-1].offset + w[-1].size for w in windows]
        groups = step_groups(sizes)
        rows = []
        for w, (window, size, group) in enumerate(zip(windows, sizes, groups, strict=True)):
            for p in window:
                doc_id, first, ids, total = self.docs[p.doc]
                crc = zlib.crc32(ids[p.start - first : p.start - first + p.size])
                rows.append((doc_id, p.start, p.size, crc, total, base + self.sequences + w, p.offset, size, step + group))
        self.sequences += len(windows)
        self.steps += max(groups, default=-1) + 1
        kept = [(self.docs[p.doc], p) for p in left]
        self.docs = [(d, p.start, ids[p.start - first : p.start - first + p.size].copy(), total) for (d, first, ids, total), p in kept]
        self.waiting = sum(p.size for p in left)
        columns = zip(*rows, strict=True) if rows else [[]] * len(COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COLUMNS)


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def packed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, tiers: Sequence[int] = TIERS) -> DataFrame:
    """A row for each piece of docs (doc_id, text): its document and place there, the crc32 of its ids, its sequence and
    place there, the sequence's length and its step group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(tokenizer), Packer(TaskContext.get().partitionId(), tiers)
        for batch in batches:
            texts, names = text_array(batch.column(1)), batch.column(0).to_pylist()
            for a, b in slices(texts):
                ids, start = encoder.encode(texts.slice(a, b - a))
                ids[start[1:] - 1] = end_id
                ids = np.ascontiguousarray(ids, "<u4")
                for name, x, y in zip(names[a:b], start[:-1].tolist(), start[1:].tolist(), strict=True):
                    packer.add(name, ids[x:y])
                if packer.waiting >= BLOCK_IDS:
                    yield packer.block(False)
        yield packer.block(True)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, ", ".join(f"{c} bigint" for c in COLUMNS))
