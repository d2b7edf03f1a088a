"""Writes token ids of a corpus as frames, in ascending document order, and reads them back.

Documents are dealt out by ranges of their id, so partitions and the rows in them are in order. Each task encodes
whole documents into frames of at most FRAME_IDS ids (a longer document is a frame of its own) and writes them with
Spark's own committer, so a lost executor's tasks just run again. A row of the file is (part, start,
n_ids, index, frame): `start` is the number of ids before it in its part, `index` lists the frame's documents, `frame`
is described in idcodec.

Defined results: a null or empty text is a document of the end id alone. A null id sorts first and is kept.
Repeated ids are separate documents, in the order of their texts. An empty table gives an empty file. A very
long text is a frame of its own. Other columns of the input, whatever their names, don't take part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from . import idcodec, kit, pretok
from .kit import per_document, slices, text_array, text_buffers

END_ID = 0
#: Ids in a frame, at most.
FRAME_IDS = idcodec.BLOCK * idcodec.LANES
#: Pieces that a worker remembers, and those of one slice more.
MEMO = 400_000
#: Text bytes of a slice: in a larger one fewer pieces are met for the first time, each of which is looked up.
SLICE_BYTES = 4 * kit.SLICE_BYTES


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(seen)))}


_CHARACTERS = _byte_characters()
#: By byte, as UTF-16; and what stands between groups of pieces, which no byte is shown as.
_UNITS = np.array([_CHARACTERS[b] for b in range(256)], "<u2")
_BETWEEN = "\n"
#: Bytes that UTF-8 never has. One that takes part in no merge stands between the pieces of a group.
_UNUSED = (0xC0, 0xC1, *range(0xF5, 0x100))
GROUP = 16


class Encoder:
    """Ids by the tokenizers library. The library sees each distinct piece once; texts with a special string, whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_BETWEEN)
        entries = self.merger.get_vocab()
        if not all(chr(c) in entries for c in _CHARACTERS.values()):
            raise ValueError("the vocabulary doesn't have all bytes")
        #: Bytes of each id; none for what stands between pieces.
        self.width = np.zeros(max(entries.values()) + 1, np.int32)
        self.width[list(entries.values())] = list(map(len, entries))
        merged = set("".join(x for x in entries if len(x) > 1))
        self.inner = next((_CHARACTERS[b] for b in _UNUSED if chr(_CHARACTERS[b]) not in merged), ord(_BETWEEN))
        if chr(self.inner) in entries:
            self.width[entries[chr(self.inner)]] = 0
        self.forget()

    def forget(self) -> None:
        #: The known pieces; the ids of one are flat[bounds[number]:bounds[number + 1]], and `used` counts its slices.
        self.known = pa.array([], pa.large_binary())
        self.flat, self.bounds, self.used = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def thin(self) -> None:
        """Forgets the pieces that only one slice had; all of them if the others are many."""
        kept = np.flatnonzero(self.used > 1)
        if len(kept) > MEMO // 2:
            return self.forget()
        self.known = self.known.take(pa.array(kept))
        sizes = np.diff(self.bounds)[kept]
        self.flat, self.bounds = pretok.gather(kept, self.flat, self.bounds), np.concatenate([[0], np.cumsum(sizes)])
        self.used = np.zeros(len(kept), np.int32)

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number of each of a slice's different pieces; the library encodes those that are new."""
        if len(self.known) > MEMO:
            self.thin()
        numbers = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = np.arange(len(self.known), len(self.known) + len(new))
            fresh = pieces.take(pa.array(new))
            flat, bounds = [self.flat], [self.bounds]
            end = len(self.flat)
            for at in range(0, len(new), 8192):
                ids, ends = self._library(fresh.slice(at, 8192))
                flat.append(ids)
                bounds.append(end + ends)
                end += len(ids)
            self.known = pa.concat_arrays([self.known, fresh])
            self.flat, self.bounds = np.concatenate(flat), np.concatenate(bounds)
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int32)])
        self.used[numbers] += 1
        return numbers

    def merges(self, text: str) -> list[int]:
        """The library's ids of pieces, each byte as the character that stands for it there, with _BETWEEN or `inner` between them."""
        return self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _library(self, some: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of the pieces, and where each piece's end.

        Pieces are what the library's own splitting gives, so they go to its merges at once, and GROUP of them in one go. An
        id's width tells which piece it is of.
        """
        offsets, raw = text_buffers(some)
        between = np.full(len(some) - 1, self.inner, np.uint16)
        between[GROUP - 1 :: GROUP] = ord(_BETWEEN)
        text = np.insert(_UNITS[np.frombuffer(raw, np.uint8)], offsets[1:-1], between).tobytes().decode("utf-16-le")
        ids = np.array(self.merges(text), np.int32)
        ids = ids[self.width[ids] > 0]
        return ids, np.searchsorted(np.cumsum(self.width[ids], dtype=np.int64), offsets[1:]) + 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each document's followed by END_ID, and each document's first (n + 1 values)."""
        pieces, code, first = pretok.distinct(texts, pretok.TOKENIZERS)
        code = self.numbers(pieces)[code]
        n = per_document(self.bounds[code + 1] - self.bounds[code], first)
        start = np.concatenate([[0], np.cumsum(n + 1)])
        ids = np.full(int(start[-1]), END_ID, np.int32)
        keep = np.ones(len(ids), bool)
        keep[start[1:] - 1] = False
        ids[keep] = pretok.gather(code, self.flat, self.bounds)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :]
        raw = memoryview(texts.buffers()[2] or b"")[int(offsets[0]) : int(offsets[len(texts)])]
        if any(s in bytes(raw) for s in self.special):
            return self._around(texts, ids, start)
        return ids, start

    def _around(self, texts: pa.Array, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = []
        for k, t in enumerate(texts.to_pylist()):
            if any(s.decode() in t for s in self.special):
                own.append(np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, END_ID], np.int32))
            else:
                own.append(ids[start[k] : start[k + 1]])
        return np.concatenate(own), np.concatenate([[0], np.cumsum([len(o) for o in own])])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


FILE = T.StructType([T.StructField("part", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("index", T.BinaryType()), T.StructField("frame", T.BinaryType())])


def _index(ids: pa.Array, sizes: np.ndarray) -> bytes:
    null = ids.is_null().to_numpy(zero_copy_only=False)
    return np.rec.fromarrays([ids.fill_null(0).to_numpy(zero_copy_only=False), sizes, null], dtype=[("id", "<i8"), ("n", "<i8"), ("null", "u1")]).tobytes()


def read_index(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=[("id", "<i8"), ("n", "<i8"), ("null", "u1")])


class Held:
    """Encoded documents that wait for their frame."""

    def __init__(self) -> None:
        self.docs: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.n = self.documents = 0

    def add(self, docs: pa.Array, ids: np.ndarray, start: np.ndarray) -> None:
        self.docs.append(docs)
        self.sizes.append(np.diff(start))
        self.ids.append(ids.astype(np.uint16) if len(ids) and ids.max() < 65536 else ids)
        self.n += len(ids)
        self.documents += len(docs)

    def take(self, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The first documents, with `most` ids in all at most (one document may have more)."""
        docs, sizes, ids = pa.concat_arrays(self.docs), np.concatenate(self.sizes), np.concatenate(self.ids)
        ends = np.cumsum(sizes)
        k = max(1, int(np.searchsorted(ends, most, side="right")))
        end = int(ends[k - 1])
        self.docs, self.sizes, self.ids = [docs[k:]], [sizes[k:]], [ids[end:].copy()]
        self.n, self.documents = len(ids) - end, len(docs) - k
        return docs[:k], sizes[:k], ids[:end]


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Encodes docs and writes the file."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    keys = ("doc_id", F.substring("text", 1, 64))  # so rows that share an id, or have none, don't all go to one task
    dealt = source.repartitionByRange(partitions, *keys) if partitions else source.repartitionByRange(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, written = TaskContext.get().partitionId(), 0
        held = Held()

        def frame(most: int) -> pa.RecordBatch:
            nonlocal written
            docs, sizes, ids = held.take(most)
            own = {"part": [part], "start": [written], "n_ids": [len(ids)], "index": [_index(docs, sizes)], "frame": [idcodec.encode_frame(ids)]}
            written += len(ids)
            return pa.RecordBatch.from_pydict(own)

        for batch in batches:
            texts = text_array(batch.column(1))
            for at, to in slices(texts, SLICE_BYTES):
                held.add(batch.column(0).slice(at, to - at), *encoder(vocabulary).encode(texts.slice(at, to - at)))
                # What is left makes half a frame at least, so no task ends with a frame of few blocks.
                while 2 * held.n > 3 * FRAME_IDS and held.documents > 1:
                    yield frame(FRAME_IDS)
            pa.default_memory_pool().release_unused()
        while held.documents:
            yield frame(FRAME_IDS if held.n > 2 * FRAME_IDS or held.n <= FRAME_IDS else held.n // 2)

    dealt.sortWithinPartitions(*keys, "text").mapInArrow(run, FILE).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the file.

    Only each part's total comes to the driver, one number a partition of the writer.
    """
    frames = spark.read.schema(FILE).parquet(path)
    totals = frames.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, start = [], 0
    for row in totals:
        before.append((row["part"], start))
        start += row["n"]
    # One row a part, so what is broadcast is bounded by the number of the writer's tasks.
    base = spark.createDataFrame(before, "part long, before long")
    placed = frames.join(F.broadcast(base), "part").select((F.col("before") + F.col("start")).alias("before"), "index", "frame")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, index, frame in zip(*(batch.column(k) for k in range(3)), strict=True):
                ids = idcodec.decode_frame(frame.as_py())
                docs = read_index(index.as_py())
                end = np.cumsum(docs["n"])
                first = end - docs["n"]
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(first.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs["id"], mask=docs["null"].astype(bool)), pa.array(at.as_py() + first), pa.array(docs["n"]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
