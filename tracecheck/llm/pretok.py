"""Splits texts into the pieces that byte-level BPE merges within, for many texts at once.

The split is that of the public pattern of byte_bpe_50k (contractions, letters, digits and others with one leading
space, white space), worked out with numpy on code points: a class a character, a piece wherever the class changes,
then the two rules that look further (white space before a word, contractions). Equal pieces are numbered, so each
distinct piece of a slice is tokenized once. The classes are those that the library in question gives to each code
point, for libraries are built with different versions of Unicode.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .kit import text_buffers

OTHER, LETTER, DIGIT, WHITE = range(4)


#: The library whose classes count by default.
TIKTOKEN, TOKENIZERS = "tiktoken", "tokenizers"


def _matched(library: str, text: str, wanted: str, other: str) -> str:
    """The characters of a text that match `wanted`, by the library's own engine; `other` matches all others."""
    if library == TIKTOKEN:
        import tiktoken  # only the library in use is loaded into a worker

        own = tiktoken.Encoding("classes", pat_str=wanted, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        return own.decode_bytes(own.encode_ordinary(text)).decode()
    from tokenizers import Regex, normalizers

    drop = normalizers.Replace(Regex(other), "")
    return "".join(drop.normalize_str(text[at : at + 4096]) for at in range(0, len(text), 4096))


@lru_cache(maxsize=2)
def classes(library: str = TIKTOKEN) -> np.ndarray:
    """The class that the library's patterns give to each code point (about 0.3 s once a worker)."""
    points = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for kind, wanted, other in ((LETTER, r"\p{L}+", r"[^\p{L}]+"), (DIGIT, r"\p{N}+", r"[^\p{N}]+"), (WHITE, r"\s+", r"\S+")):
        table[np.frombuffer(_matched(library, points, wanted, other).encode("utf-32-le"), np.uint32)] = kind
    return table


def piece_starts(points: np.ndarray, firsts: np.ndarray, library: str = TIKTOKEN) -> np.ndarray:
    """Marks the code points at which a piece starts. firsts: where texts start."""
    n = len(points)
    kind = classes(library)[points]
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    first_at = first[:n]
    start |= first_at
    # White space before anything else of the same text: its last character stands alone, or leads the next piece.
    last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~first_at[1:])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        quote = quote[quote + 1 < n]
        quote = quote[start[quote] & (kind[quote + 1] == LETTER) & ~first_at[quote + 1]]
        one = points[quote + 1]
        two = np.where(first[np.minimum(quote + 2, n)], 0, points[np.minimum(quote + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for hit, size in ((short, 2), (long, 3)):
            q = quote[hit]
            start[q + 1] = False
            after = q + size
            start[after[after < n]] = True
    return start


def distinct(texts: pa.Array, library: str = TIKTOKEN) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces, the number of the piece at each place, and each text's first place (n + 1 values)."""
    offsets, raw = text_buffers(texts)
    size = int(offsets[-1])
    if not size:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    data = np.frombuffer(raw, np.uint8)
    points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    inner = offsets[:-1][offsets[:-1] < size]
    if len(points) == size:
        starts = np.flatnonzero(piece_starts(points, inner, library))
    else:
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # the byte at which each code point starts
        starts = lead[np.flatnonzero(piece_starts(points, np.searchsorted(lead, inner), library))]
    ends = np.append(starts, size).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
    return pieces.dictionary, pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offsets)


def split(texts: pa.Array, library: str = TIKTOKEN) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """As distinct, with the pieces as a list."""
    pieces, code, first = distinct(texts, library)
    return pieces.to_numpy(zero_copy_only=False).tolist(), code, first


def split_around(texts: pa.Array, special: re.Pattern[str] | None, library: str = TIKTOKEN) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """As split, but texts are first cut at each match of `special`; the last value counts these by text."""
    if special is None or not any(map(special.search, texts.to_pylist())):
        return *split(texts, library), np.zeros(len(texts), np.int64)
    parts = [special.split(t) for t in texts.to_pylist()]
    count = np.array([len(p) for p in parts], np.int64)
    pieces, code, first = split(pa.array([x for p in parts for x in p], pa.large_string()), library)
    return pieces, code, first[np.concatenate([[0], np.cumsum(count)])], count - 1


def gather(code: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """values[bounds[c]:bounds[c + 1]] for each c of code, one after the other."""
    start = bounds[code]
    size = bounds[code + 1] - start
    total = int(size.sum())
    if not total:
        return values[:0]
    at = np.repeat(start - (np.cumsum(size) - size), size)
    at += np.arange(total)
    return values[at]
