"""Words as maximal runs of bytes other than ASCII white space, found for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .kit import text_buffers

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends (bytes) and, for each text, the number of its first word (n + 1 values)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~space
    start, end = word.copy(), word.copy()
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]  # a text's end also ends a word
    start[edges] = word[edges]
    end[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def codes(raw: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal byte spans get equal numbers."""
    if not len(starts):
        return np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    length = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    if offsets[-1] == len(data):
        packed = data
    else:
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1  # spans don't overlap and none is empty
        inside[ends] -= 1
        packed = data[np.cumsum(inside[:-1]) > 0]
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])
    return array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def of(texts: pa.Array) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, text offsets, word starts, word ends, first word of each text."""
    offsets, raw = text_buffers(texts)
    data = np.frombuffer(raw, np.uint8)
    return raw, offsets, *spans(data, offsets, SPACE[data])
