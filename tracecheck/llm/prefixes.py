"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the trie's root. Turn by turn, the classes that are still active are split by
the next turn; each part is a node. A class of a single conversation is retired: its tail is a chain of nodes with one
child each and is written at once. Large classes are split by grouping over all rows, one turn a round; a class is
taken out of these rounds once its tails have at most LOCAL turns, and tasks then split many such classes side by side
in the same way. Numbers of leaves and saved bytes are folded back from children to parents.

Turns are compared by a 128-bit digest of role and text, so texts are read once. Conversations that are alike in all
turns are one member with a weight, which keeps large groups of copies out of the rounds. A node's list of the
conversations that end there is the list of one such group; it is hashed as a stream in order of the ids. (A SHA-256 is
made in sequence, so the ids of one group of copies pass through one task, a batch at a time.)

Rebuilding: conversation c gets the first h turns of conversation c - c mod 5 (the multiple of 5 at or below it), with
h = crc32(c in decimal) mod 9, and then its own turns after its first h.

Defined results: turns are ordered by number, nulls first, equal ones by role and then text; repeated rows are repeated
turns. A null role or text is an empty one. Rows without a conversation id belong to no conversation and make no node.
An empty table gives an empty table; otherwise there is a root. Texts and conversations may be of any length. Other
columns of the input, whatever their names, don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kit import table

#: Remaining turns of a class up to which one task splits it further, and rows that a task works on at once, at about.
LOCAL, BATCH = 1 << 14, 1 << 17
HEAD = 9  # shared turns are counted modulo this

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends bigint, top boolean"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, pos, key, n_bytes): each turn's place from 1, a digest of its role and text, the bytes of its text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    own = turns.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text")).where("conv is not null")
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    key = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 32))
    return own.select("conv", F.row_number().over(order).cast("long").alias("pos"), key.alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv, n: their number of turns), and their turns (conv, pos, key, n_bytes)."""
    rows = table(numbered(turns))
    own = table(rows.groupBy("conv").agg(F.max("pos").alias("size")))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEAD))
    named = own.withColumn("h", h).withColumn("base", F.try_subtract("conv", F.pmod("conv", F.lit(5))))
    joined = named.join(own.select(F.col("conv").alias("base"), F.col("size").alias("of_base")), "base", "left")
    info = joined.withColumn("shared", F.least("h", F.coalesce("of_base", F.lit(0)))).withColumn("n", F.col("shared") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    info = table(info.select("conv", "base", "h", "shared", "n"))
    heads = rows.where(F.col("pos") < HEAD).withColumnRenamed("conv", "base").join(info.where("shared > 0"), "base").where("pos <= shared").select("conv", "pos", "key", "n_bytes")
    tails = rows.join(info.where("n > shared").select("conv", "h", "shared"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "key", "n_bytes")
    return info.select("conv", "n"), table(heads.unionAll(tails))


def copies(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One conversation (conv, n, w: how many there are) of those that are alike in all turns; and (rep, conv) of those
    that aren't alone. The hashes of (place, key) are put together without regard to order, so a long conversation isn't
    gathered."""
    marks = [F.bit_xor(F.xxhash64("pos", "key")).alias("a"), F.bit_xor(F.xxhash64("key", "pos", F.lit("b"))).alias("b")]
    whole = convs.join(rows.groupBy("conv").agg(*marks), "conv", "left").select("conv", "n", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    whole = table(whole)
    reps = table(whole.groupBy("n", "a", "b").agg(F.min("conv").alias("rep"), F.count("*").alias("w")))
    members = whole.join(reps.where("w > 1"), ["n", "a", "b"]).select("rep", "conv")
    return reps.select(F.col("rep").alias("conv"), "n", "w"), members


def id_digests(members: DataFrame) -> DataFrame:
    """(rep, sha256): of each group's ids in decimal, ascending, joined by commas."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, hashlib.sha256()

        def made(reps: list[int], found: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(found, pa.string())], names=["rep", "sha256"])

        for batch in batches:
            reps, ids = (batch.column(k).to_numpy() for k in range(2))
            cuts = np.append(np.flatnonzero(np.append(True, reps[1:] != reps[:-1])), len(reps)).tolist() if len(reps) else [0]
            done: tuple[list[int], list[str]] = ([], [])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                text = ",".join(map(str, ids[a:b].tolist()))
                if int(reps[a]) == last:
                    digest.update(b"," + text.encode())
                    continue
                if last is not None:
                    done[0].append(last)
                    done[1].append(digest.hexdigest())
                last, digest = int(reps[a]), hashlib.sha256(text.encode())
            yield made(*done)
        if last is not None:
            yield made([last], [digest.hexdigest()])

    return members.repartition("rep").sortWithinPartitions("rep", "conv").mapInArrow(run, "rep bigint, sha256 string")


@dataclass
class Tails:
    """The tails of classes' conversations, by class, conversation and turn; a row a turn."""

    top: np.ndarray  # of each conversation: its class, the depth of the class's node, the node above
    depth: np.ndarray
    parent: np.ndarray
    conv: np.ndarray
    weight: np.ndarray
    first: np.ndarray  # its first row (one more value than there are conversations)
    key: np.ndarray  # of each row: equal turns have equal numbers
    n_bytes: np.ndarray

    @staticmethod
    def of(t: pa.Table) -> Tails:
        top, depth, parent, conv, weight = (t.column(c).to_numpy() for c in ("top", "at", "parent", "conv", "w"))
        first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        key = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        return Tails(top[first], depth[first], parent[first], conv[first], weight[first], np.append(first, len(conv)), key.astype(np.int64), t.column("n_bytes").to_numpy())


def refine(x: Tails) -> dict[str, np.ndarray]:
    """All nodes below and at the classes' nodes, folded back; `ends`: the conversation that ends there, if `ended`."""
    size, levels = np.diff(x.first), []  # of each level: the nodes' columns
    member, of = np.arange(len(x.conv)), np.unique(x.top, return_inverse=True)[1]  # active conversations and their classes' numbers
    above, step = x.parent, 0  # by conversation: the node above, as an id
    up = np.full(len(x.conv), -1)  # and as a row of the level before
    chains: list[tuple[np.ndarray, ...]] = []
    while len(member):
        row = x.first[member] + step
        pair = of * (int(x.key.max()) + 1) + x.key[row]
        _, lead, part = np.unique(pair, return_index=True, return_inverse=True)  # conversations ascend, so the first has the least id
        lone = np.bincount(part) == 1
        single = lone[part]
        chains.append((member[single], np.full(int(single.sum()), step), above[single], up[single]))
        keep = ~single
        member, above, up, row = member[keep], above[keep], up[keep], row[keep]
        if not len(member):
            break
        number = np.cumsum(~lone) - 1
        part, lead = number[part[keep]], lead[~lone]
        k = int(part.max()) + 1
        order = np.zeros(k, np.int64)
        order[part[::-1]] = np.arange(len(part))[::-1]  # the first of each part
        total = np.bincount(part, x.weight[member], k).astype(np.int64)
        over = size[member] == step + 1
        ends, ended = np.zeros(k, np.int64), np.zeros(k, bool)
        ends[part[over]], ended[part[over]] = x.conv[member[over]], True
        levels.append({"conv_id": x.conv[member[order]], "depth": x.depth[member[order]] + step, "parent_conv_id": above[order], "up": up[order], "n_convs": total,
                       "saved": (total - 1) * x.n_bytes[row[order]], "ends": ends, "ended": ended, "top": np.full(k, step == 0)})
        above, up = levels[-1]["conv_id"][part], part
        member, of, above, up = member[~over], part[~over], above[~over], up[~over]
        step += 1
    own, start, over_id, over_row = (np.concatenate(c) for c in zip(*chains, strict=True))
    n = size[own] - start
    at = np.repeat(x.first[own] + start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    chain = np.repeat(np.arange(len(own)), n)
    head, tail = np.cumsum(n) - n, np.cumsum(n) - 1
    cost = (x.weight[own][chain] - 1) * x.n_bytes[at]
    run = np.cumsum(cost)
    saved = run[tail][chain] - run + cost
    place = np.arange(len(at)) - head[chain]
    is_tail, is_head = np.zeros(len(at), bool), np.zeros(len(at), bool)
    is_tail[tail], is_head[head] = True, True
    conv = x.conv[own][chain]
    found = [{"conv_id": conv, "depth": x.depth[own][chain] + start[chain] + place, "parent_conv_id": np.where(is_head, over_id[chain], conv), "n_convs": x.weight[own][chain], "n_children": (~is_tail).astype(np.int64),
              "n_leaves": np.ones(len(at), np.int64), "saved_tokens": saved, "ends": conv, "ended": is_tail, "top": is_head & (start[chain] == 0)}]
    children = leaves = sums = None
    for s in range(len(levels) - 1, -1, -1):
        level = levels[s]
        k = len(level["conv_id"])
        kids, tips, below = (np.zeros(k, np.int64) for _ in range(3))
        if children is not None:
            for to, values in ((kids, np.ones(len(children), np.int64)), (tips, leaves), (below, sums)):
                np.add.at(to, children, values)
        mine = start == s + 1
        np.add.at(kids, over_row[mine], 1)
        np.add.at(tips, over_row[mine], 1)
        np.add.at(below, over_row[mine], saved[head[mine]])
        tips[kids == 0] = 1
        sums, leaves, children = level["saved"] + below, tips, level["up"]
        found.append({**{c: level[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs")}, "n_children": kids, "n_leaves": tips, "saved_tokens": sums, "ends": level["ends"], "ended": level["ended"], "top": level["top"]})
    return {c: np.concatenate([f[c] for f in found]) for c in found[0]}


def split_locally(tails: DataFrame) -> DataFrame:
    """NODE rows of small classes; tails: top, at, parent, conv, w, pos, key, n_bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def nodes(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            found = refine(Tails.of(pa.Table.from_batches(parts)))
            missing = ~found.pop("ended")
            return pa.RecordBatch.from_arrays([pa.array(c, mask=missing if name == "ends" else None) for name, c in found.items()], names=list(found))

        for batch in batches:
            if not batch.num_rows:
                continue
            top = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(np.append(True, top[1:] != top[:-1]))[-1])  # the last class may go on
            if held and (cut or held[-1].column(0)[-1].as_py() != top[0]) and sum(h.num_rows for h in held) + cut >= BATCH:
                yield nodes([*held, batch.slice(0, cut)] if cut else held)
                held = []
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            yield nodes(held)

    dealt = tails.select("top", "at", "parent", "conv", "w", "pos", "key", "n_bytes").repartition("top").sortWithinPartitions("top", "conv", "pos")
    return dealt.mapInArrow(run, NODE)


def chains(rows: DataFrame) -> DataFrame:
    """NODE rows of retired conversations: a chain each; rows: at (where the chain starts), parent, conv, w, n, pos, n_bytes."""
    ahead = Window.partitionBy("conv").orderBy(F.desc("pos"))
    saved = F.sum((F.col("w") - 1) * F.col("n_bytes")).over(ahead)
    parent = F.when(F.col("pos") == F.col("at"), F.col("parent")).otherwise(F.col("conv"))
    last = F.col("pos") == F.col("n")
    return rows.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), parent.alias("parent_conv_id"), F.col("w").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                       saved.alias("saved_tokens"), F.when(last, F.col("conv")).alias("ends"), (F.col("pos") == F.col("at")).alias("top"))


def prefix_trie(turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """A row for each distinct sequence of a rebuilt conversation's first turns; turns: conv_id, turn, role, text.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    convs, rows = rebuilt(turns)
    reps, members = copies(convs, rows)
    root = reps.agg(F.min("conv").alias("conv_id"), F.sum("w").alias("n_convs"), F.min(F.when(F.col("n") == 0, F.col("conv"))).alias("ends")).where("conv_id is not null")
    own = table(rows.join(reps, "conv"))
    # Rounds: each large class is split by its next turn.
    large = [table(root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("own_saved"), "ends"))]
    # A class goes by its least conversation; all conversations start in the root's.
    least = large[0].agg(F.min("conv_id")).first()[0]
    active = own.where("pos = 1").select("conv", F.lit(least).cast("long").alias("class"))
    retired: list[DataFrame] = []
    while True:
        depth = len(large)
        now = own.where(F.col("pos") == depth).join(active, "conv")
        split = table(now.groupBy("class", "key").agg(F.min("conv").alias("new"), F.count("*").alias("k"), F.sum("w").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") - depth + 1).alias("rest"), F.min(F.when(F.col("n") == depth, F.col("conv"))).alias("ends")))
        big = (F.col("k") > 1) & (F.col("rest") > local)
        dealt = table(now.select("conv", "class", "key", "n").join(split.select("class", "key", "new", "k", big.alias("big")), ["class", "key"]).select("conv", "class", "n", "new", "k", "big"))
        retired.append(dealt.where("not big").select("conv", F.col("class").alias("parent"), F.col("new").alias("top"), (F.col("k") == 1).alias("alone"), F.lit(depth).cast("long").alias("at")))
        nodes = table(split.where(big).select(F.col("new").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("class").alias("parent_conv_id"), "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own_saved"), "ends"))
        if nodes.isEmpty():
            break
        large.append(nodes)
        active = dealt.where(F.col("big") & (F.col("n") > depth)).select("conv", F.col("new").alias("class"))
    out = retired[0]
    for r in retired[1:]:
        out = out.unionAll(r)
    tails = table(own.join(out, "conv").where("pos >= at"))
    below = table(split_locally(tails.where("not alone")).unionAll(chains(tails.where("alone"))))
    # Fold back: the large classes' nodes, from the deepest up.
    done, tops = below.drop("top"), below.where("top").select("depth", "parent_conv_id", "n_leaves", "saved_tokens")
    for nodes in large[::-1]:
        kids = tops.groupBy(F.col("depth").alias("under"), F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        joined = nodes.join(kids.withColumn("depth", F.col("under") - 1).drop("under"), ["conv_id", "depth"], "left")
        folded = joined.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.col("own_saved") + F.coalesce("below", F.lit(0))).alias("saved_tokens"), "ends")
        folded = table(folded)
        done = done.unionByName(folded)
        tops = tops.unionAll(folded.select("depth", "parent_conv_id", "n_leaves", "saved_tokens"))
    digests = id_digests(members)
    sha = F.coalesce("sha256", F.sha2(F.coalesce(F.col("ends").cast("string"), F.lit("")).cast("binary"), 256))
    return done.join(digests, F.col("ends") == F.col("rep"), "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))
