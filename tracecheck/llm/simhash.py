"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed once a document; equal ones are merged before anything is compared. Distinct
fingerprints are packed into tiles of equal population counts (of each 16-bit quarter). Two fingerprints within
the radius have quarter counts that differ by at most the radius in sum, so all other tile pairs are skipped
without loss; the rest is compared exactly with numpy exclusive-or and bit counts. A tile pair returns a
spanning forest of its links, never all linked pairs. Components are then found by alternating star
contractions over written tables.

Beyond the fingerprints' links, `near_duplicates` can also link texts of a given similarity (`Similar`), for which
fingerprints may differ in any number of bits. Texts that share one of their smallest shingle hashes meet in a tile;
pairs whose numbers of shingles and parity maps allow the similarity are candidates, and the exact share of common
shingles decides. Each text first offers its first candidate and its nearest. While some text has more, the links found
so far are merged into groups and it offers NEAREST times as many of other groups, until each candidate was compared or
lies in the text's own group.

Defined results: a null or empty text, or one without a word, has fingerprint zero and links like any other.
Repeated rows each get a row; rows of one id are one document: texts are compared each by itself, and what either of an
id's texts is linked to is linked.
A null id takes part in no component of others' ids: it gets a null component unless its fingerprint also belongs to a
document with an id. An empty table gives an empty table. Other columns of the input, whatever their names, don't take
part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kit import checkpoint, map_texts, table, text_buffers

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Fingerprints in a tile at most.
TILE = 2048
#: Tiles of one cell whose pairs are compared under one key, on either side.
TOGETHER = 8
#: Candidates that a text offers within a tile at first, besides its first partner, and their growth from round to round.
NEAREST = 3
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of `size` words, joined by spaces; of the whole sequence if it is shorter."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[: len(parts) - size].tolist()]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * count > len(hashes)).tolist()))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, to: str = "fp", size: int = SHINGLE) -> DataFrame:
    """Adds the 64-bit fingerprint as a long (two's complement)."""

    def each(texts: pa.Array) -> list[pa.Array]:
        offsets, raw = text_buffers(texts)
        return [_signed([fingerprint(shingle_hashes(bytes(raw[a:b]), size)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])]

    return map_texts(docs, text, each, [(to, T.LongType())], keep)


def quarter_counts(values: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, packed a byte each."""
    quarters = values.astype("<u8").view("<u2").reshape(-1, 4)
    c = np.bitwise_count(quarters).astype(np.int64)
    return c[:, 0] | c[:, 1] << 8 | c[:, 2] << 16 | c[:, 3] << 24


def neighbour_steps(radius: int) -> list[tuple[int, ...]]:
    """Steps between quarter counts that a pair within the radius can have; of each step and its opposite, one."""
    return [s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0)]


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links between a and b within the radius connect, at most one a fingerprint.

    Fingerprints are numbered through a and then b. Each strip's links only lower the labels: the smallest number
    reached so far; an edge leads from each fingerprint to its label.
    """
    step = max(1, (1 << 20) // max(1, len(b)))
    label = np.arange(len(a) + len(b))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        i, j = i + at, j + len(a)
        while len(i):
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # roots are joined, so what they stand for follows
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def by_counts(nodes: DataFrame) -> DataFrame:
    """nodes (fp, node) with their cell: the packed quarter counts."""
    return nodes.mapInPandas(lambda it: (p.assign(cell=quarter_counts(p["fp"].to_numpy(np.int64).view(np.uint64))) for p in it), "fp long, node long, cell long")


def tiles(cells: DataFrame) -> DataFrame:
    """Packs (cell, fp, node) rows into tiles: their cell, a number, and their rows as bytes."""
    schema = "cell long, part int, fps binary, ids binary"
    # The number of tiles a cell is split into follows its count, which is known before rows move.
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    parts = cells.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / (TILE / 2))).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for at in range(0, len(pdf), TILE):  # a part is rarely over TILE rows
            p = pdf.iloc[at : at + TILE]
            rows.append((int(p["cell"].iloc[0]), int(p["part"].iloc[0]) * 64 + at // TILE, p["fp"].to_numpy(np.int64).tobytes(), p["node"].to_numpy(np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["cell", "part", "fps", "ids"])

    return parts.select("cell", "part", "fp", "node").groupBy("cell", "part").applyInPandas(pack, schema)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) node pairs that connect all fingerprints of `nodes` (fp, node: both distinct) within the radius."""
    packed = checkpoint(tiles(by_counts(nodes)))
    steps = neighbour_steps(radius)
    moves = F.array(*[F.lit(sum(x << (8 * i) for i, x in enumerate(s))).cast("long") for s in steps])
    # Tile pairs go as rows of their own, so the tiles of a full cell don't meet in one task.
    own = packed.select(F.col("cell").alias("ca"), F.col("part").alias("pa")).withColumn("cb", F.explode(F.transform(moves, lambda m: m + F.col("ca"))))
    pairs = own.join(packed.select(F.col("cell").alias("cb"), F.col("part").alias("pb")), "cb").where("ca <> cb or pa <= pb")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fa, ia, fb, ib in zip(*(batch.column(k) for k in ("fa", "ia", "fb", "ib")), strict=True):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (fa, fb))
                ids = np.frombuffer(ia.as_py() + ib.as_py(), np.int64)
                i, j = forest(a, b, radius)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    return tile_pairs(pairs, packed, ["fps", "ids"], ["fa", "ia", "fb", "ib"]).mapInArrow(compare, "a long, b long").where("a <> b")


def tile_pairs(pairs: DataFrame, packed: DataFrame, columns: list[str], to: list[str]) -> DataFrame:
    """The columns of both tiles of each pair (ca, pa, cb, pb), named `to`; each pair is a row with a key of its own."""
    k = len(columns)
    sides = [packed.select(F.col("cell").alias(f"c{x}"), F.col("part").alias(f"p{x}"), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]) for x, names in (("a", to[:k]), ("b", to[k:]))]
    return pairs.join(sides[0], ["ca", "pa"]).join(sides[1], ["cb", "pb"]).select(*to)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b). Nodes without an edge have no row.

    Alternating large-star and small-star contractions: edges never grow in number, and rounds grow with the
    logarithm of the nodes. Minima are pre-aggregated before they are shuffled.
    """
    e = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(e.select(F.col("v"), F.col("u")))
        seen = table(both.groupBy("n").agg(F.min("m").alias("r"), F.count("*").alias("k")))
        # All are stars once each node with a smaller neighbour has that neighbour only.
        if seen.where("r < n and k > 1").isEmpty():
            return seen.where("r < n").select(F.col("n").alias("node"), F.col("r").alias("root"))
        # Large star: larger neighbours of n point to n's minimum.
        least = seen.select("n", F.least("n", "r").alias("r"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("r").alias("v")).where("u <> v").distinct()
        # Small star: n and its smaller neighbours point to their minimum.
        low = large.groupBy("u").agg(F.min("v").alias("r"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("r").alias("v")), F.struct(F.col("v").alias("u"), F.col("r").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = table(small)


@dataclass(frozen=True)
class Similar:
    """Texts count as near duplicates from this share of common shingles (of `size` words) on."""

    size: int = 5
    share: float = 0.8
    #: Smallest shingle hashes of a text, of which two texts have to share one. At a share of 0.8, one in 10 ** 6 pairs does not.
    sketch: int = 8
    #: Bits of a text's parity map, at least; a text with more shingles has the next power of two, so that maps tell long
    #: texts apart, too. Each bit in which two maps differ is a shingle that only one of the texts has.
    bits: int = 1024
    #: Candidates that are sent to the texts' scan; where there are more, texts are joined to them by a shuffle.
    sent: int = 100_000


def map_bits(n: int, least: int) -> int:
    """Bits of the parity map of n distinct hashes."""
    return max(least, 1 << (n - 1).bit_length() if n else 1)


def folded(raw: bytes, bits: int) -> bytes:
    """A map of twice the bits as one of `bits`: that of the same hashes."""
    halves = np.frombuffer(raw, np.uint8).reshape(2, bits // 8)
    return (halves[0] ^ halves[1]).tobytes()


def parity(own: np.ndarray, bits: int) -> bytes:
    """A bit is 1 if an odd number of the distinct hashes fall on it."""
    return np.packbits(np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _sketched(named: DataFrame, size: int, similar: Similar) -> DataFrame:
    """(doc_id, fp, n, digest, sketch, map): n distinct shingles, a digest, the smallest and the parity map of their hashes."""

    def each(texts: pa.Array) -> list[pa.Array]:
        offsets, raw = text_buffers(texts)
        fps, counts, digests, smallest, maps = [], [], [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text = bytes(raw[a:b])
            fps.append(fingerprint(shingle_hashes(text, size)))
            own = np.unique(shingle_hashes(text, similar.size))
            counts.append(len(own))
            digests.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            smallest.append(own[: similar.sketch].view(np.int64))
            maps.append(parity(own, map_bits(len(own), similar.bits)))
        flat = np.concatenate([np.zeros(0, np.int64), *smallest])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in smallest])])
        return [_signed(fps), pa.array(counts, pa.int64()), _signed(digests), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(maps, pa.binary())]

    fields = [("fp", T.LongType()), ("n", T.LongType()), ("digest", T.LongType()), ("sketch", T.ArrayType(T.LongType())), ("map", T.BinaryType())]
    return map_texts(named, "text", each, fields, ["doc_id"])


@dataclass(frozen=True)
class Tile:
    """Texts of one cell with maps of equally many bits: node, group, number of shingles, guest, and map (a row a text).

    A guest's own map has twice the bits; it is here, with a folded one, for the texts that are not guests.
    """

    nodes: np.ndarray
    groups: np.ndarray
    n: np.ndarray
    guest: np.ndarray
    maps: np.ndarray

    def to_bytes(self) -> bytes:
        return b"".join([self.nodes.tobytes(), self.groups.tobytes(), self.n.tobytes(), self.guest.astype(np.int64).tobytes(), self.maps.tobytes()])

    @staticmethod
    def of(raw: bytes, bits: int) -> Tile:
        rows = np.frombuffer(raw, np.uint64)
        k = len(rows) // (4 + bits // 64)
        nodes, groups, n, guest = rows[: 4 * k].view(np.int64).reshape(4, k)
        return Tile(nodes, groups, n, guest > 0, rows[4 * k :].reshape(k, -1))

    @staticmethod
    def made(bits: int, nodes: np.ndarray, groups: np.ndarray, n: np.ndarray, maps: list[bytes]) -> Tile:
        """Of texts with maps of these bits, or twice as many."""
        guest = np.array([len(m) * 8 > bits for m in maps], bool)
        whole = b"".join(folded(m, bits) if g else m for m, g in zip(maps, guest.tolist(), strict=True))
        return Tile(nodes, groups, n, guest, np.frombuffer(whole, np.uint64).reshape(len(maps), -1))

    def part(self, a: int, b: int) -> Tile:
        return Tile(self.nodes[a:b], self.groups[a:b], self.n[a:b], self.guest[a:b], self.maps[a:b])


def closest(left: Tile, right: Tile, similar: Similar, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of two groups that may be of the similarity: of these each left text's first partner, and its `most`
    nearest; and the left texts that have more.

    Of two texts with a and b shingles, the smaller number has to be a share of the larger one, and at most
    (1 - share) / (1 + share) * (a + b) shingles are in only one of them; their maps can't differ in more bits.
    """
    i, j, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    share, slack = similar.share, 1e-6  # a rounding error may not reject a pair
    apart = (1 - share) / (1 + share)
    step = max(1, (1 << 20) // max(1, len(right.n)))
    for at in range(0, len(left.n), step):
        own = left.part(at, at + step)
        a, b = own.n.astype(np.float64)[:, None], right.n.astype(np.float64)[None, :]
        good = (a + slack >= share * b) & (b + slack >= share * a) & (own.groups[:, None] != right.groups[None, :]) & ~(own.guest[:, None] & right.guest[None, :])
        rows = np.flatnonzero(good.any(axis=1))
        if not len(rows):
            continue
        good = good[rows]
        bits = np.zeros(good.shape, np.uint16 if right.maps.shape[1] <= 1000 else np.uint32)
        for w in range(right.maps.shape[1]):
            bits += np.bitwise_count(own.maps[rows, w][:, None] ^ right.maps[:, w][None, :])
        good &= bits <= apart * (a[rows] + b) + slack
        some = good.any(axis=1)
        rows, good, bits = rows[some], good[some], bits[some]
        if not len(rows):
            continue
        i.append(rows + at)
        j.append(good.argmax(axis=1))
        far = np.iinfo(bits.dtype).max
        bits[~good] = far
        more.append(rows[good.sum(axis=1) > most] + at)
        near = np.argpartition(bits, most - 1, axis=1)[:, :most] if bits.shape[1] > most else np.broadcast_to(np.arange(bits.shape[1]), bits.shape)
        x, y = np.nonzero(np.take_along_axis(bits, near, axis=1) < far)
        i.append(rows[x] + at)
        j.append(near[x, y])
    return np.concatenate(i), np.concatenate(j), np.concatenate(more)


def similar_roots(named: DataFrame, nodes: DataFrame, known: DataFrame, similar: Similar) -> DataFrame:
    """(node, root) as of `components`, over the edges `known` and all pairs of the given share of shingles.

    nodes: node, doc_id, n, digest, sketch, map. Texts that are connected already aren't compared again, nor are cells in
    which each text has offered all its candidates. Cells are weighed by the sizes of their texts' maps.
    """
    weight = F.ceil(F.octet_length("map") * 8 / similar.bits).cast("int")
    keyed = nodes.select(F.explode("sketch").alias("cell"), "node", weight.alias("w"))  # maps are joined to what is compared only
    sizes = keyed.groupBy("cell").agg(F.count("*").alias("__n")).where("__n > 1")
    met = table(keyed.join(sizes.select("cell"), "cell"))
    roots, again, tested, most = components(known), None, None, NEAREST
    while True:
        grouped = met.join(roots.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
        grouped = grouped.withColumn("again", F.lit(True)) if again is None else grouped.join(again, "node", "left")
        open_ = grouped.groupBy("cell").agg(F.sum("w").alias("__n"), F.min("group").alias("x"), F.max("group").alias("y"), F.max("again").alias("again")).where("x <> y and again").select("cell", "__n")
        rows = table(grouped.drop("again").join(open_, "cell"))  # groups only grow, so other cells are done with
        met = rows.select("cell", "node", "w")
        offers = table(offered(rows.join(nodes.select("node", "n", "map"), "node"), similar, most).distinct())
        edges = offers.where("a <> b")
        fresh = table(edges.join(tested, ["a", "b"], "left_anti")) if tested is not None else edges
        found = table(verified(named, nodes, fresh, similar))
        if not found.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found))
        again = offers.where("a = b").select(F.col("a").alias("node"), F.lit(True).alias("again"))
        if again.isEmpty():
            return roots
        tested = fresh if tested is None else tested.unionAll(fresh)
        most *= NEAREST


def offered(met: DataFrame, similar: Similar, most: int) -> DataFrame:
    """(a, b) candidate pairs of the cells' texts, at most so many a text and tile; (a, a) for a text that has more.

    A text meets those with maps of as many bits as its own and, if it may be similar to them, those with half as many.
    """

    def ends(a: Tile, b: Tile) -> pa.RecordBatch:
        i, j, more = closest(a, b, similar, most)
        pairs = np.concatenate([np.stack([a.nodes[i], b.nodes[j]], axis=1), np.stack([a.nodes[more]] * 2, axis=1)])
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows)
            cell, bits, node, group, n = (table.column(k).to_numpy() for k in range(5))
            maps = table.column(5).to_pylist()
            bounds = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (bits[1:] != bits[:-1]), [True]])).tolist()
            found = [ends(t, t) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a + 1 for t in [Tile.made(int(bits[a]), node[a:b], group[a:b], n[a:b], maps[a:b])]]
            yield from pa.Table.from_batches(found, _PAIRS).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            last = np.flatnonzero(cell != cell[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (cut or held[-1].column(0)[-1].as_py() != cell[0]):
                yield from pairs([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield from pairs([batch.slice(0, cut)])
            held.append(batch.slice(cut))
            pa.default_memory_pool().release_unused()
        if held:
            yield from pairs(held)
        pa.default_memory_pool().release_unused()  # workers live on

    own = F.octet_length("map") * 8
    guest = (own > similar.bits) & (similar.share * F.col("n") <= own / 2 + 1e-6)
    both = met.withColumn("bits", F.explode(F.when(guest, F.array(own, (own / 2).cast("int"))).otherwise(F.array(own))))
    few = both.where(F.col("__n") <= TILE).select("cell", "bits", "node", "group", "n", "map").repartition("cell").sortWithinPartitions("cell", "bits").mapInArrow(compare, "a long, b long")
    packed = checkpoint(tiles_with_sizes(both.where(F.col("__n") > TILE)))

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bits, x, y in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                yield ends(Tile.of(x.as_py(), bits.as_py()), Tile.of(y.as_py(), bits.as_py()))
            pa.default_memory_pool().release_unused()

    # Tiles meet by blocks of TOGETHER tiles: a key has a bounded number of tile pairs, and a tile goes to few keys.
    own = (F.col("part") / TOGETHER).cast("int")
    blocks = F.sequence(F.lit(0), ((F.col("parts") - 1) / TOGETHER).cast("int"))
    left = packed.withColumn("own", own).select("cell", "bits", "part", F.col("rows").alias("r1"), F.col("own").alias("b1"), F.explode(F.filter(blocks, lambda b: b >= own)).alias("b2"))
    right = packed.withColumn("own", own).select("cell", "bits", F.col("part").alias("p2"), F.col("rows").alias("r2"), F.explode(F.filter(blocks, lambda b: b <= own)).alias("b1"), F.col("own").alias("b2"))
    many = left.join(right, ["cell", "bits", "b1", "b2"]).where("part <= p2").select("bits", "r1", "r2").mapInArrow(across, "a long, b long")
    return few.unionAll(many)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verified(named: DataFrame, nodes: DataFrame, edges: DataFrame, similar: Similar) -> DataFrame:
    """The edges between nodes whose texts have at least the given share of shingles in common."""
    wanted, n = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), edges.count()
    if not n:
        return edges
    wanted = wanted.join(nodes.select("node", F.col("doc_id").alias("__doc"), "digest"), "node")
    if n <= similar.sent:
        wanted = F.broadcast(wanted)
    # An id may have several texts: the node's are those with its digest, and one of them is enough.
    texts = named.join(wanted, F.col("doc_id") == F.col("__doc")).select("node", "digest", "text")

    def shingles(texts_: pa.Array) -> list[pa.Array]:
        own = [np.unique(shingle_hashes(t.encode(), similar.size)) for t in texts_.to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        flat = np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in own)])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), _signed([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in own])]

    sets = map_texts(texts, "text", shingles, [("s", T.ArrayType(T.LongType())), ("d", T.LongType())], ["node", "digest"]).where("d = digest").dropDuplicates(["node"])
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similar.share * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def tiles_with_sizes(cells: DataFrame) -> DataFrame:
    """Tiles of (cell, bits, node, group, n, map, __n: weight of the cell) rows: cell, bits, part, parts (of the cell), rows (a Tile as bytes)."""
    counted = cells.withColumn("parts", F.ceil(F.col("__n") / (TILE / 2)).cast("int"))
    parts = counted.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = int(pdf["bits"].iloc[0])
        tile = Tile.made(bits, *(pdf[c].to_numpy(np.int64) for c in ("node", "group", "n")), list(pdf["map"]))
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "bits": [bits], "part": [pdf["part"].iloc[0]], "parts": [pdf["parts"].iloc[0]], "rows": [tile.to_bytes()]})

    return parts.select("cell", "bits", "part", "parts", "node", "group", "n", "map").groupBy("cell", "bits", "part").applyInPandas(pack, "cell long, bits int, part int, parts int, rows binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE, similar: Similar | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; with `similar`, texts of that similarity are linked too."""
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    fps = table(fingerprints(named, "text", keep=["doc_id"], size=size) if similar is None else _sketched(named, size, similar))
    one = fps.where("doc_id is not null")
    # Equal fingerprints are linked, but their texts may differ: with `similar`, each set of shingles is a node of its own.
    key = ["fp"] if similar is None else ["fp", "digest"]
    made = one.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), *[F.min_by(c, "doc_id").alias(c) for c in ("n", "sketch", "map") if similar is not None])
    nodes = table(made.withColumn("node", F.monotonically_increasing_id()))  # a name of its own, for an id may have several texts
    # Rows of an id that has several nodes link these.
    several = one.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y"), *[F.min("digest").alias("u"), F.max("digest").alias("v")][: 2 * (len(key) - 1)])
    several = table(several.where("x <> y" if similar is None else "x <> y or u <> v").select("doc_id"))
    alike = one.join(several, "doc_id").select(F.col("doc_id").alias("id"), *key).join(nodes.select(*key, "node"), key)
    alike = alike.join(alike.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")).where("a <> b")
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    known = links(firsts, radius).unionAll(alike)
    if similar is None:
        roots = components(known)
    else:
        same = nodes.join(firsts.withColumnRenamed("node", "first"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
        roots = similar_roots(named, nodes, table(known.unionAll(same)), similar)
    rooted = table(nodes.join(roots, "node", "left").select(*key, "doc_id", F.coalesce("root", "node").alias("root")))
    classes = rooted.select(*key, "root").join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select(*key, "component_id")
    return fps.select("doc_id", *key).join(classes, key, "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
