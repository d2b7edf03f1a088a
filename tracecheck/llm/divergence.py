"""Source divergence audit by mergeable radix tries.

Terms are counted in byte tries: each task holds one radix trie of its texts' terms, with counters for each
(language, source) at the leaves. Tries are cut at short prefixes, and the pieces of a prefix from all tasks merge in
one task, which takes a range of prefixes; a prefix whose pieces are large is cut deeper first, so no task gets more
than a bounded part of them. The merged tries are walked in UTF-8 order: the walk streams each pair of sources' share
of the divergence, and for each source the terms that it has most of, so equal values stay in term order.

With count c of a kept term in a group, N of all kept terms there and V kept terms in the language,
p = 1 + floor(10^9 (c + 2) / (N + 2V)); two groups differ at a term by floor((p - q)^2 / (p + q)). All in whole numbers.

Defined results: null text, lang or source count as ''. Each row is a document, also where an id or a row repeats. A
text without terms still gives its group. A language without kept terms has pairs of value 0 and no term rows; one of a
single source has no pairs. An empty table gives an empty table. A term may be as long as its text. Other columns of
the input, whatever their names, don't take part. Counts go to 9 * 10^15 a language.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kit import slices, table, text_array, text_buffers

#: Documents of its language that a kept term is in, at least; ranks that are listed of a group's terms.
LEAST_DOCS, RANKS = 10, 10
#: Leaves that a task's trie holds; it is cut up and sent off once it has more.
LEAVES = 150_000
#: Bytes of a prefix's pieces up to which they are merged as they are, and the depth of the first cut.
RANGE_BYTES, CUT = 32 << 20, 2
#: Bytes of terms whose paths are read off many at once.
SHORT = 64
#: Cells of a matrix of terms and sources worked on at once.
CELLS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_COUNTED = pa.schema([("term", pa.large_binary()), ("group", pa.int32()), ("count", pa.int64()), ("docs", pa.int64())])


@dataclass(frozen=True)
class Trie:
    """A radix trie in preorder. Each leaf is given by the depth at which it leaves the path of the leaf before it and
    the bytes from there on; leaf i's counters are those from first[i] to first[i + 1]: a group each, with its count
    and its number of documents."""

    depth: np.ndarray
    size: np.ndarray
    labels: bytes
    first: np.ndarray
    group: np.ndarray
    count: np.ndarray
    docs: np.ndarray

    @staticmethod
    def of(counted: pa.Table) -> Trie:
        """The trie of counted terms (term, group, count, docs) in any order; equal ones are summed up."""
        return Trie.built(summed(counted))

    @staticmethod
    def built(t: pa.Table) -> Trie:
        """The trie of counted terms that `summed` has put in order."""
        if not len(t):
            none = np.zeros(0, np.int64)
            return Trie(none, none, b"", np.zeros(1, np.int64), none, none, none)
        terms = t.column("term").combine_chunks()
        at = np.flatnonzero(_new_terms(terms))
        offsets, raw = _bytes_of(terms.take(pa.array(at)))
        depth = common_depth(raw, offsets)
        inside = np.zeros(len(raw) + 1, np.int8)
        np.add.at(inside, offsets[:-1] + depth, 1)
        np.add.at(inside, offsets[1:], -1)
        labels = raw[np.cumsum(inside[:-1]) > 0].tobytes()
        return Trie(depth, np.diff(offsets) - depth, labels, np.append(at, len(t)).astype(np.int64), *(t.column(c).to_numpy() for c in ("group", "count", "docs")))

    @staticmethod
    def joined(tries: list[Trie]) -> Trie:
        """The tries' leaves one after the other, for reading only: a trie starts anew where a leaf leaves the root."""
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(t.first) for t in tries]))])
        parts = (np.concatenate([getattr(t, c) for t in tries]) for c in ("group", "count", "docs"))
        return Trie(np.concatenate([t.depth for t in tries]), np.concatenate([t.size for t in tries]), b"".join(t.labels for t in tries), first, *parts)

    def terms(self) -> list[bytes]:
        """The leaves' paths, in UTF-8 order."""
        return self.paths().to_pylist()

    def paths(self) -> pa.Array:
        """The leaves' paths as an array. A byte of a path comes from the last leaf that has one of its own at that depth."""
        length = self.depth + self.size
        if length.max(initial=0) > SHORT:
            found, path, at = [], b"", 0
            for d, n in zip(self.depth.tolist(), self.size.tolist(), strict=True):
                path = path[:d] + self.labels[at : at + n]
                at += n
                found.append(path)
            return pa.array(found, pa.large_binary())
        labels, starts = np.frombuffer(self.labels, np.uint8), np.cumsum(self.size) - self.size
        place, parts, step = np.arange(int(length.max(initial=0))), [], 1 << 14
        above = np.zeros(len(place), np.int64)  # where in labels the last bytes at each depth are
        for at in range(0, len(length), step):
            depth, size = self.depth[at : at + step, None], self.size[at : at + step, None]
            own = (place >= depth) & (place < depth + size)
            where = np.where(own, starts[at : at + step, None] - depth + place, -1)
            where[0] = np.where(own[0], where[0], above)
            np.maximum.accumulate(where, axis=0, out=where)
            above = where[-1]
            parts.append(labels[where[place < depth + size]])
        bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        raw = np.concatenate([np.zeros(0, np.uint8), *parts])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])

    def counted(self, groups: np.ndarray | None = None) -> pa.Table:
        """What the trie was made of; groups: new numbers of its groups."""
        of = np.repeat(np.arange(len(self.depth)), np.diff(self.first))
        group = self.group if groups is None else groups[self.group]
        return pa.Table.from_arrays([self.paths().take(pa.array(of)), pa.array(group.astype(np.int32)), pa.array(self.count), pa.array(self.docs)], schema=_COUNTED)

    def cut(self, depth: int) -> Iterator[tuple[bytes, Trie]]:
        """The tries below each prefix of `depth` bytes (or a whole shorter term)."""
        at = np.append(np.flatnonzero(self.depth < depth), len(self.depth)).tolist()
        ends, terms = np.concatenate([[0], np.cumsum(self.size)]), self.terms()
        for a, b in zip(at[:-1], at[1:], strict=True):
            own, size = self.depth[a:b].copy(), self.size[a:b].copy()
            own[0], size[0] = 0, len(terms[a])
            c, d = int(self.first[a]), int(self.first[b])
            yield terms[a][:depth], Trie(own, size, terms[a] + self.labels[int(ends[a + 1]) : int(ends[b])], self.first[a : b + 1] - c, self.group[c:d], self.count[c:d], self.docs[c:d])

    def to_bytes(self) -> bytes:
        """All numbers in as few bytes as the largest of their kind needs."""
        parts = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (self.depth, self.size, np.diff(self.first), self.group, self.count, self.docs)]
        head = np.array([len(self.depth), len(self.group), *(p.itemsize for p in parts)], np.int64)
        return head.tobytes() + b"".join(p.tobytes() for p in parts) + self.labels

    @staticmethod
    def from_bytes(raw: bytes) -> Trie:
        n, m, *sizes = np.frombuffer(raw, np.int64, 8).tolist()
        at, parts = 64, []
        for many, size in zip((n, n, n, m, m, m), sizes, strict=True):
            parts.append(np.frombuffer(raw, f"<u{size}", many, at).astype(np.int64))
            at += many * size
        return Trie(parts[0], parts[1], raw[at:], np.concatenate([[0], np.cumsum(parts[2])]), *parts[3:])


def summed(counted: pa.Table) -> pa.Table:
    """Counted terms in order, each term and group once."""
    if not len(counted):
        return counted
    terms = counted.column("term").combine_chunks().dictionary_encode()
    order = pc.sort_indices(terms.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    group = counted.column("group").to_numpy().astype(np.int64)
    many = int(group.max()) + 1
    key = rank[terms.indices.to_numpy()] * many + group
    by = np.argsort(key, kind="stable")
    key = key[by]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sums = (np.add.reduceat(counted.column(c).to_numpy()[by], at) for c in ("count", "docs"))
    term, of = np.divmod(key[at], many)
    return pa.Table.from_arrays([terms.dictionary.take(order).take(pa.array(term)), pa.array(of, pa.int32()), *map(pa.array, sums)], schema=_COUNTED)


def _new_terms(terms: pa.Array) -> np.ndarray:
    """True where a term isn't the one before it."""
    return np.append(True, pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)) if len(terms) else np.zeros(0, bool)


def _bytes_of(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    raw = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[int(offsets[0]) : int(offsets[-1])]
    return offsets - offsets[0], raw


def common_depth(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Leading bytes that each string shares with the one before it."""
    n = len(offsets) - 1
    depth, size = np.zeros(n, np.int64), np.diff(offsets)
    least = np.minimum(size[1:], size[:-1])
    pair, d = np.flatnonzero(least > 0), 0
    while len(pair):
        pair = pair[raw[offsets[pair] + d] == raw[offsets[pair + 1] + d]]
        d += 1
        depth[pair + 1] = d
        pair = pair[least[pair] > d]
    return depth


class Groups:
    """Numbers of the groups that a trie's counters speak of."""

    def __init__(self) -> None:
        self.number: dict[tuple[str, str], int] = {}

    def of(self, names: Iterable[tuple[str, str]]) -> np.ndarray:
        return np.array([self.number.setdefault(n, len(self.number)) for n in names], np.int64)

    def names(self) -> list[tuple[str, str]]:
        return list(self.number)


def count_terms(texts: pa.Array, group: np.ndarray) -> pa.Table:
    """(term, group, count, docs) of texts; group: a number for each."""
    offsets, view = text_buffers(texts)
    raw = _LOWER[np.frombuffer(view, np.uint8)]
    inside = _IN_TERM[raw]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]  # a text's end also ends a term
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return _COUNTED.empty_table()
    bounds = np.concatenate([[0], np.cumsum(np.flatnonzero(end) + 1 - starts)])
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw[inside])]).dictionary_encode()
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n = len(terms.dictionary)
    pairs, counts = np.unique(doc * n + terms.indices.to_numpy(), return_counts=True)
    which, term = np.divmod(pairs, n)
    cells, of, docs = np.unique(group[which] * n + term, return_inverse=True, return_counts=True)
    of_group, term = np.divmod(cells, n)
    total = np.bincount(of, counts, len(cells)).astype(np.int64)  # below 2 ** 53
    return pa.Table.from_arrays([terms.dictionary.take(pa.array(term)), pa.array(of_group, pa.int32()), pa.array(total), pa.array(docs.astype(np.int64))], schema=_COUNTED)


_PIECES = "prefix binary, whole boolean, langs array<string>, sources array<string>, trie binary"


def _pieces(trie: Trie, names: list[tuple[str, str]], depth: int) -> Iterator[pa.RecordBatch]:
    """The trie's pieces as rows; a row names the groups of its own counters only."""
    rows: list[tuple] = []
    for prefix, piece in trie.cut(depth):
        used, group = np.unique(piece.group, return_inverse=True)
        own = Trie(piece.depth, piece.size, piece.labels, piece.first, group, piece.count, piece.docs)
        rows.append((prefix, len(piece.depth) == 1 and int(piece.size[0]) <= depth, [names[g][0] for g in used], [names[g][1] for g in used], own.to_bytes()))
    if rows:
        kinds = (pa.binary(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary())
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 4096], strict=True), kinds, strict=True)], names=["prefix", "whole", "langs", "sources", "trie"])


def tries(docs: DataFrame) -> DataFrame:
    """Pieces of the tasks' tries of docs (text, lang, source)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, rows, limit = Groups(), [], 0, LEAVES
        for batch in batches:
            texts, names = text_array(batch.column(0)), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for a, b in slices(texts):
                held.append(count_terms(texts.slice(a, b - a), groups.of(names[a:b])))
                rows += len(held[-1])
                if rows > limit:
                    held = [summed(pa.concat_tables(held))]
                    rows = len(held[0])
                    limit = rows + LEAVES
                    if rows > LEAVES:
                        yield from _pieces(Trie.built(held[0]), groups.names(), CUT)
                        groups, held, rows, limit = Groups(), [], 0, LEAVES
            pa.default_memory_pool().release_unused()
        if held:
            yield from _pieces(Trie.of(pa.concat_tables(held)), groups.names(), CUT)

    return docs.select("text", "lang", "source").mapInArrow(run, _PIECES)


def cut_deeper(pieces: DataFrame) -> DataFrame:
    """The pieces, with those of a prefix that has over RANGE_BYTES of them cut at longer prefixes, until none has."""
    depth = CUT
    while True:
        heavy = table(pieces.where("not whole").groupBy("prefix").agg(F.sum(F.length("trie")).alias("n")).where(F.col("n") > RANGE_BYTES).select("prefix"))
        if heavy.isEmpty():
            return pieces
        depth *= 2

        def run(batches: Iterable[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, langs, sources, raw in (tuple(x.as_py() for x in row) for row in zip(*batch.columns, strict=True)):
                    yield from _pieces(Trie.from_bytes(raw), list(zip(langs, sources, strict=True)), depth)

        pieces = table(pieces.join(heavy, "prefix", "left_anti").unionAll(pieces.join(heavy, "prefix", "left_semi").mapInArrow(run, _PIECES)))


def merged(pieces: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Tries of the terms that each language keeps, by ranges of prefixes: lang, trie, sources (of its counters), and
    v, n: its terms, and the counts of each source."""

    def kept(t: pa.Table, groups: Groups) -> Iterator[tuple]:
        names = groups.names()
        langs = {lang: k for k, lang in enumerate(dict.fromkeys(n[0] for n in names))}
        lang = np.array([langs[n[0]] for n in names], np.int64)[t.column("group").to_numpy()]
        leaf = np.cumsum(_new_terms(t.column("term").combine_chunks())) - 1
        docs = np.zeros((len(langs), int(leaf[-1]) + 1), np.int64)
        np.add.at(docs, (lang, leaf), t.column("docs").to_numpy())
        stays = docs[lang, leaf] >= least_docs
        for name, k in langs.items():
            own = t.filter(pa.array(stays & (lang == k)))
            if len(own):
                used, group = np.unique(own.column("group").to_numpy(), return_inverse=True)
                trie = Trie.built(own.set_column(1, "group", pa.array(group, pa.int32())))
                sums = np.zeros(len(used), np.int64)
                np.add.at(sums, trie.group, trie.count)
                yield name, trie.to_bytes(), [names[g][1] for g in used], len(trie.depth), sums.tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, waiting, rows, last, limit = Groups(), [], [], 0, None, LEAVES

        def one() -> pa.Table:
            return summed(pa.concat_tables([*held, Trie.joined(waiting).counted()] if waiting else held))

        def out() -> Iterator[pa.RecordBatch]:
            found = list(kept(one(), groups)) if rows else []
            if found:
                kinds = (pa.string(), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["lang", "trie", "sources", "v", "n"])

        for batch in batches:
            for prefix, langs, sources, raw in (tuple(x.as_py() for x in row) for row in zip(*batch.columns, strict=True)):
                if rows > limit:
                    if prefix != last:  # whole prefixes only
                        yield from out()
                        groups, held, waiting, rows, limit = Groups(), [], [], 0, LEAVES
                        pa.default_memory_pool().release_unused()
                    else:
                        held, waiting = [one()], []
                        rows = len(held[0])
                        limit = rows + LEAVES
                t = Trie.from_bytes(raw)
                waiting.append(replace(t, group=groups.of(zip(langs, sources, strict=True))[t.group]))
                rows += len(t.group)
                last = prefix
        yield from out()

    dealt = pieces.select("prefix", "langs", "sources", "trie").repartitionByRange("prefix").sortWithinPartitions("prefix")
    return dealt.mapInArrow(run, "lang string, trie binary, sources array<string>, v bigint, n array<bigint>")


def share(count: np.ndarray, of: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / of), three digits at a time, so nothing overflows."""
    rest, found = count + 2, np.zeros(np.broadcast(count, of).shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, of)
        found = found * 1000 + digit
    return found + 1


def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def walk(trie: Trie, sources: list[int], n: np.ndarray, v: int, ranks: int) -> tuple[np.ndarray, list[list[tuple[int, bytes]]]]:
    """The trie's share of each pair's value (a matrix, upper half), and each source's terms of the highest values.

    sources: the numbers of the counters' sources among those of the language; n: all sources' counts.
    """
    s, terms = len(n), trie.terms()
    pairs, best = np.zeros((s, s), np.int64), [[] for _ in range(s)]
    column, step = np.array(sources, np.int64)[trie.group], max(1, CELLS // s)
    for at in range(0, len(terms), step):
        to = min(at + step, len(terms))
        a, b = int(trie.first[at]), int(trie.first[to])
        counts = np.zeros((to - at, s), np.int64)
        counts[np.repeat(np.arange(to - at), np.diff(trie.first[at : to + 1])), column[a:b]] = trie.count[a:b]
        p = share(counts, n[None, :] + 2 * v)
        whole = share(counts.sum(axis=1), int(n.sum()) + 2 * v)
        for k in range(s - 1):
            pairs[k, k + 1 :] += differ(p[:, k : k + 1], p[:, k + 1 :]).sum(axis=0)
        above = np.where((counts > 0) & (p > whole[:, None]), differ(p, whole[:, None]), -1)
        for k in range(s):
            top = np.argsort(-above[:, k], kind="stable")[:ranks]
            found = [(int(above[i, k]), terms[at + i]) for i in top.tolist() if above[i, k] >= 0]
            best[k] = sorted(best[k] + found, key=lambda x: -x[0])[:ranks]
    return pairs, best


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's terms are from those of the other sources of its
    language (part pair), and the terms that it has most of beyond its language (part term)."""
    own = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = table(own.select("lang", "source").distinct())
    parts = table(merged(cut_deeper(table(tries(own))), least_docs))
    kept = parts.groupBy("lang").agg(F.sum("v").alias("v"))
    counts = parts.select("lang", F.explode(F.arrays_zip("sources", "n")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.n").alias("n"))
    full = groups.join(counts, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of_lang = full.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("all")).join(kept, "lang")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, raw, names, every, n, v in (tuple(x.as_py() for x in row) for row in zip(*batch.columns, strict=True)):
                number = {name: k for k, name in enumerate(every)}
                pairs, best = walk(Trie.from_bytes(raw), [number[x] for x in names], np.array(n, np.int64), v, ranks)
                i, j = np.triu_indices(len(every), 1)
                rows = [(lang, every[a], "pair", every[b], x) for a, b, x in zip(i.tolist(), j.tolist(), pairs[i, j].tolist(), strict=True)]
                rows += [(lang, every[k], "term", term.decode(), x) for k, found in enumerate(best) for x, term in found]
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["lang", "source", "part", "item", "value"])

    asked = parts.select("lang", "trie", "sources").join(of_lang, "lang").select("lang", "trie", "sources", F.col("all.source").alias("every"), F.col("all.n").alias("n"), "v")
    streamed = table(asked.mapInArrow(run, "lang string, source string, part string, item string, value bigint"))
    half = streamed.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.unionAll(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    every = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = every.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionAll(streamed.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= ranks)).select("lang", "source", "part", "item", "value", "rank")
