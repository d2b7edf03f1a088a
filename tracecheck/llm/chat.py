"""Chat formatting by columnar byte assembly.

Turns arrive sorted. For a batch, the lengths of all headers, contents and footers give cumulative offsets, which
give scatter indices; bytes are then copied into one preallocated buffer, which becomes the Arrow column as it is.
No string is built a turn.

Template: a conversation starts with <s>. A user turn is "[INST] text [/INST]", an assistant turn " text</s>", a system
turn "<<SYS>>\\ntext\\n<</SYS>>\\n\\n", any other role "[ROLE] name-as-JSON\\ntext[/ROLE]". Control strings inside texts are
escaped by one backslash after their first character; a text that already has backslashes there gets one more, so
reading back is exact. The loss mask covers the assistants' texts.

Defined results: a null text is an empty one; a null role is written as JSON null and read back as null; a null
conversation id is a conversation of its own. Turns with equal numbers are ordered by role, then text. Repeated rows
are repeated turns. Conversations and texts of any length are put together; only whole conversations are written. An empty
table gives an empty table. Other columns of the input, whatever their names, don't take part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kit import text_buffers

START = "<s>"
WRAP = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
OTHER_END = "[/ROLE]"
#: What may follow < or [ in a control string.
_TAIL = r"/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]"
_CONTROL = re.compile(rf"([<\[])(\\*)(?={_TAIL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_TAIL})")
_MAYBE = re.compile(rb"[<\[]\\*[/<sIR]")
#: Text bytes put together at once, at about.
BATCH_BYTES = 8 << 20


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def wrap(role: str | None) -> tuple[str, str]:
    return WRAP.get(role) or (f"[ROLE] {escape(json.dumps(role, ensure_ascii=False))}\n", OTHER_END)


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """out[to[i]:to[i]+sizes[i]] = data[starts[i]:starts[i]+sizes[i]] for all i at once."""
    total = int(sizes.sum())
    if total:
        before = np.cumsum(sizes) - sizes
        step = np.arange(total)
        out[np.repeat(to - before, sizes) + step] = data[np.repeat(starts - before, sizes) + step]


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Formats the turns of whole conversations.

    conv: the number of each turn's conversation, rising from 0. Returns the formatted strings, and for each
    assistant's turn its conversation's number and the first and last code point (exclusive) of its text.
    """
    if _MAYBE.search(text_buffers(texts)[1]):
        texts = pa.array([escape(t) if "<" in t or "[" in t else t for t in texts.to_pylist()], pa.large_string())
    offsets, raw = text_buffers(texts)
    content = np.frombuffer(raw, np.uint8)
    kinds = roles.dictionary_encode()
    which = kinds.indices.fill_null(len(kinds.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    names = [*kinds.dictionary.to_pylist(), None]
    frames = [tuple(x.encode() for x in wrap(r)) for r in names]
    pool = np.frombuffer(b"".join([START.encode(), *(x for f in frames for x in f)]), np.uint8)
    sizes = np.array([[len(h), len(f)] for h, f in frames], np.int64)
    places = len(START) + np.concatenate([[0], np.cumsum(sizes.ravel())[:-1]]).reshape(-1, 2)
    head, foot = sizes[which, 0], sizes[which, 1]
    first = np.ones(len(conv), bool)
    first[1:] = conv[1:] != conv[:-1]
    lead = np.where(first, len(START), 0)
    body = np.diff(offsets)
    size = lead + head + body + foot
    end = np.cumsum(size)
    at = end - size
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    _scatter(out, at, pool, np.zeros(len(at), np.int64), lead)
    _scatter(out, at + lead, pool, places[which, 0], head)
    _scatter(out, at + lead + head, content, offsets[:-1], body)
    _scatter(out, at + lead + head + body, pool, places[which, 1], foot)
    bounds = np.append(at[first], len(out)).astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(out)])
    # Code points before each byte, to give the mask in characters.
    points = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=points[1:])
    speaks = np.flatnonzero(np.array([n == "assistant" for n in names])[which])
    base = points[bounds[:-1][conv[speaks]]]
    a = (at + lead + head)[speaks]
    return formatted, conv[speaks], points[a] - base, points[a + body[speaks]] - base


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row a conversation of turns (conv_id, turn, role, text)."""
    source = turns.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids = table.column("conv_id").combine_chunks()
        new = _changes(ids)
        conv = np.cumsum(new) - 1
        strings = (table.column(c).combine_chunks().cast(pa.large_string()) for c in ("role", "text"))
        formatted, of, start, end = assemble(conv, *strings)
        n = np.bincount(of, minlength=len(formatted))
        spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"])
        loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), spans)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.flatnonzero(new))), formatted.cast(pa.string()), loss], names=["conv_id", "formatted", "loss"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = 0
            cuts = np.flatnonzero(_changes(batch.column(0))).tolist()
            if held and held[-1].column(0)[-1].as_py() == batch.column(0)[0].as_py():
                cuts = cuts[1:]  # the first conversation goes on from the batch before
            ends = text_buffers(batch.column(2).cast(pa.large_string()))[0]
            for cut in cuts:
                grown = size + int(ends[cut] - ends[at])
                if grown >= BATCH_BYTES and (held or cut > at):
                    held.append(batch.slice(at, cut - at))
                    yield done([h for h in held if h.num_rows])
                    held, size, at = [], 0, cut
            held.append(batch.slice(at))
            size += int(ends[-1] - ends[at])
        if held:
            yield done(held)

    return dealt.mapInArrow(run, SCHEMA)


def _changes(ids: pa.Array) -> np.ndarray:
    """True where a value differs from the one before; the first is True."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    value = ids.fill_null(0).to_numpy(zero_copy_only=False)
    new = np.ones(len(ids), bool)
    new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return new


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """The turns of a formatted conversation."""
    at, turns = len(START), []
    if not formatted.startswith(START):
        raise ValueError("no start mark")
    while at < len(formatted):
        for role, (head, foot) in WRAP.items():
            if formatted.startswith(head, at):
                break
        else:
            if not formatted.startswith("[ROLE] ", at):
                raise ValueError(f"no turn at {at}")
            line = formatted.index("\n", at)
            role, head, foot = json.loads(unescape(formatted[at + 7 : line])), formatted[at : line + 1], OTHER_END
        end = formatted.index(foot, at + len(head))
        turns.append((role, unescape(formatted[at + len(head) : end])))
        at = end + len(foot)
    return turns
