"""Conversation prefix trie (operator 12): shared beginnings of conversations.

Level-synchronous construction.  At each depth the live conversations are grouped by
(parent node, next turn); a group is a node, named by its depth and its least conv_id.
Grouping is an aggregate with map-side combining; members learn their node by a join,
in which the few nodes that hold more than a thousandth of all conversations are
broadcast.  A conversation is live while its node has members that differ from it later
on.  Where all members of a node are alike (one conversation, or copies), the rest of
the path is a chain, and is read off the turns of the least member at once; so the
number of levels is the longest beginning that different conversations share, not the
longest conversation.  Reverse level-by-level joins roll up leaves and savings.

Every level is settled.  Turns are numbered by a range sort whose parts count for
themselves, so one conversation may span many tasks; sums along a chain have two levels.
The hash over a node's ends is sequential by definition: ids are range-sorted, written
to text in parts of at most ``ENDS`` ids, and parts of one node meet in order.

Defined results: turns are ordered by turn (nulls first), role and text; null roles and
texts are empty; repeated rows are turns of their own; rows without conv_id belong to no
conversation; very long texts enter by SHA-256 (of role and text) and size only, and
turns are alike where the hashes are; conversations are alike where 128 bits over their
hashed turns are; ids are whole numbers; empty tables give empty tables; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, attach, settle, unsettle

#: Ids in a part of a node's ends.
ENDS = 1 << 16
#: Turns in a bucket of a chain's sums.
BUCKET = 4096


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Place of each turn among those of its conversation in this part, which is sorted."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        conv = b["conv_id"].to_numpy()
        if not len(conv):
            continue
        first = np.concatenate([[True], conv[1:] != conv[:-1]])
        at = np.arange(len(conv))
        place = at - at[first][np.cumsum(first) - 1]
        if conv[0] == last:
            place[: int(np.argmax(conv != last)) if (conv != last).any() else len(conv)] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        yield b.assign(part=part, place=place)


def turns_of(df: DataFrame) -> DataFrame:
    """Settled (conv_id, part, place, key, bytes): each turn's place within the part of a
    range sort; key stands for role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    raw = df.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    sorted_ = raw.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", key.alias("key"), F.octet_length("text").cast("long").alias("bytes"))
    return settle(sorted_.mapInPandas(_numbered, "conv_id long, key binary, bytes long, part int, place long"), "turns")


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with their positions from 0, and (conv_id, own) of all conversations."""
    counts = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before")).filter("before > 0")
    # Conversations that began in an earlier part: at most one a part.
    at = turns.join(F.broadcast(before), (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    return at.select("conv_id", "key", "bytes", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos")), counts.groupBy("conv_id").agg(F.sum("n").alias("own"))


def shared_beginnings(turns: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilds conversations: conversation c begins with the first h turns of c - c % group,
    h being crc32(c) % most, and goes on with its own after its first h.  Returns settled
    (conv_id, depth, key, bytes) and (conv_id, length) of all, turnless ones too."""
    at, convs = placed(turns)
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": F.crc32(F.col("conv_id").cast("string")) % most})
    sizes = convs.select(F.col("conv_id").alias("b"), F.col("own").alias("base_own"))
    head = F.least("h", F.coalesce("base_own", F.lit(0)))
    plans = settle(convs.join(sizes, F.col("base") == F.col("b"), "left").select("conv_id", "own", "base", "h", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "plans")
    total = turns.count()
    first = at.filter(F.col("pos") < most - 1).select(F.col("conv_id").alias("b"), "key", "bytes", "pos")
    heads = plans.select("conv_id", "base", "h").join(first, (F.col("base") == F.col("b")) & (F.col("pos") < F.col("h"))).select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "bytes")
    own = plans.select(F.col("conv_id").alias("c"), "h", "head", F.col("own").alias("size"))
    tails = attach(at, own, F.col("conv_id") == F.col("c"), F.col("size") * HOT > total).filter("pos >= h").select("conv_id", (F.col("head") + F.col("pos") - F.col("h") + 1).alias("depth"), "key", "bytes")
    built = settle(heads.union(tails).sortWithinPartitions("depth"), "rebuilt")
    return built, plans.select("conv_id", "length")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: settled (conv_id, depth, key, bytes) and (conv_id, length)."""
    at, convs = placed(turns)
    return settle(at.select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "bytes").sortWithinPartitions("depth"), "rebuilt"), convs.withColumnRenamed("own", "length")


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (node, depth, conv_id) to hashes; as text where a neighbour may have the rest."""
    part, no, current, ids, first = TaskContext.get().partitionId(), 0, None, [], True

    def text(done: bool):
        joined = ",".join(map(str, ids)).encode()
        return (*current, part, no, hashlib.sha256(joined).hexdigest() if done else None, None if done else joined)

    for b in batches:
        node, depth, conv = (b[c].to_numpy() for c in ("node", "depth", "conv_id"))
        if not len(node):
            continue
        cuts = np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1
        rows = []
        for lo, hi in zip([0, *cuts], [*cuts, len(node)]):
            key = (int(node[lo]), int(depth[lo]))
            if key != current:
                if current is not None:
                    rows.append(text(done=not first and no == 0))
                    first = False
                current, ids, no = key, [], 0
            ids += conv[lo:hi].tolist()
            while len(ids) > ENDS:
                ids, kept = ids[:ENDS], ids[ENDS:]
                rows.append(text(done=False))
                ids, no = kept, no + 1
        yield pd.DataFrame(rows, columns=["node", "depth", "part", "no", "sha", "ids"])
    if current is not None:
        yield pd.DataFrame([text(done=False)], columns=["node", "depth", "part", "no", "sha", "ids"])


def _joined_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of nodes, in order, to hashes; a part at a time."""
    current = state = None
    for b in batches:
        rows = []
        for node, depth, ids in zip(b["node"], b["depth"], b["ids"]):
            if (node, depth) != current:
                if current is not None:
                    rows.append((*current, state.hexdigest()))
                current, state = (node, depth), hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
        yield pd.DataFrame(rows, columns=["node", "depth", "sha"])
    if current is not None:
        yield pd.DataFrame([(*current, state.hexdigest())], columns=["node", "depth", "sha"])


def ends_of(finished: DataFrame) -> DataFrame:
    """(node, depth, sha) of settled (node, depth, conv_id)."""
    order = ["node", "depth", "conv_id"]
    parts = settle(finished.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInPandas(_ends, "node long, depth long, part int, no long, sha string, ids binary"), "ends")
    split = parts.filter("sha IS NULL").repartition("node", "depth").sortWithinPartitions("node", "depth", "part", "no").select("node", "depth", "ids")
    return parts.filter("sha IS NOT NULL").select("node", "depth", "sha").union(split.mapInPandas(_joined_ends, "node long, depth long, sha string"))


def trie(built: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes over conversations given as settled (conv_id, depth, key, bytes), depth from
    1 without gaps, and (conv_id, length): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (bytes of last texts, for each member but one, over
    the subtree), ends_sha256."""
    content = built.groupBy(F.col("conv_id").alias("c")).agg(F.expr("bit_xor(xxhash64(depth, key))").alias("x"), F.expr("bit_xor(xxhash64(key, depth, 1))").alias("y"))
    cand = convs.join(content, F.col("conv_id") == F.col("c"), "left").select("conv_id", F.lit(None).cast("long").alias("parent"), F.lit(b"").alias("key"), F.lit(0).cast("long").alias("bytes"), "length", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    cand = settle(cand, "live-0")
    total, turns = cand.count(), built.count()
    levels: list[DataFrame] = []
    finished: list[DataFrame] = []
    live = total
    while live:
        depth = len(levels)
        alike = (F.min("x") == F.max("x")) & (F.min("y") == F.max("y")) & (F.min("length") == F.max("length"))
        nodes = settle(cand.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.max("length").alias("length"), alike.alias("alike")), f"nodes-{depth}")
        levels.append(nodes)
        names = nodes.select(F.col("parent").alias("p"), F.col("key").alias("k"), "node", "n", "alike")
        known = attach(cand, names, F.col("parent").eqNullSafe(F.col("p")) & (F.col("key") == F.col("k")), F.col("n") * HOT > total)
        known = settle(known.select("conv_id", "node", "length", "x", "y", (F.col("alike") | (F.col("length") == depth)).alias("done")), f"members-{depth}")
        finished.append(known.filter("done").select("node", F.col("length").alias("depth"), "conv_id"))
        following = built.filter(F.col("depth") == depth + 1).select(F.col("conv_id").alias("c"), "key", "bytes")
        before, cand = cand, settle(known.filter("NOT done").join(following, F.col("conv_id") == F.col("c")).select("conv_id", F.col("node").alias("parent"), "key", "bytes", "length", "x", "y"), f"live-{depth + 1}")
        unsettle(before)
        live = cand.count()
    if not levels:
        return convs.limit(0).select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], F.lit("").alias("ends_sha256"))

    # Chains: the turns after the node where all members are alike.
    heads = settle(reduce(DataFrame.union, [t.filter("alike").select(F.col("node").alias("head"), F.lit(d).cast("long").alias("at"), "n", "length") for d, t in enumerate(levels)]), "heads")
    tail = attach(built, heads, F.col("conv_id") == F.col("head"), F.col("length") * HOT > turns).filter("depth > at")
    tail = settle(tail.select("conv_id", "depth", "bytes", "n", "length", F.floor(F.col("depth") / BUCKET).alias("b")), "tails")
    sums = tail.groupBy("conv_id", "b").agg(F.sum("bytes").alias("s"))
    after = sums.select(F.col("conv_id").alias("c"), F.col("b").alias("q"), (F.sum("s").over(Window.partitionBy("conv_id").orderBy(F.desc("b"))) - F.col("s")).alias("after"))
    several = after.filter("after > 0")  # none but chains of several buckets
    inside = F.sum("bytes").over(Window.partitionBy("conv_id", "b").orderBy(F.desc("depth")))
    rest = tail.withColumn("inside", inside).join(several, (F.col("conv_id") == F.col("c")) & (F.col("b") == F.col("q")), "left")
    long = lambda x: x.cast("long")
    chain = rest.select("conv_id", "depth", F.col("conv_id").alias("parent"), "n", long(F.when(F.col("depth") < F.col("length"), 1).otherwise(0)).alias("children"), long(F.lit(1)).alias("leaves"),
                        ((F.col("n") - 1) * (F.col("inside") + F.coalesce("after", F.lit(0)))).alias("saved"))

    # Reverse: children's leaves and savings by parent.
    chained = sums.groupBy(F.col("conv_id").alias("c")).agg(F.sum("s").alias("chain_bytes"))
    rolled: list[DataFrame] = []
    for depth in range(len(levels) - 1, -1, -1):
        t = levels[depth].join(chained, F.col("node") == F.col("c"), "left").select("parent", "node", "n", "length", "alike", "bytes", F.when(F.col("alike"), F.coalesce("chain_bytes", F.lit(0))).otherwise(0).alias("chain_bytes"))
        if rolled:
            below = rolled[-1].groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        else:
            below = t.limit(0).select(F.col("node").alias("p"), *[long(F.lit(0)).alias(c) for c in ("children", "leaves", "saved")])
        t = t.join(below, F.col("node") == F.col("p"), "left")
        rolled.append(settle(t.select(
            F.col("node").alias("conv_id"), long(F.lit(depth)).alias("depth"), "parent", "n",
            F.when(F.col("alike"), long(F.when(F.col("length") > depth, 1).otherwise(0))).otherwise(F.col("children")).alias("children"),
            F.when(F.col("alike"), long(F.lit(1))).otherwise(F.col("leaves")).alias("leaves"),
            ((F.col("n") - 1) * (F.col("bytes") + F.col("chain_bytes")) + F.coalesce("saved", F.lit(0))).alias("saved"),
        ), f"rolled-{depth}"))
    nodes = reduce(DataFrame.union, [*rolled, chain])
    ends = ends_of(settle(reduce(DataFrame.union, finished), "finished")).select(F.col("node").alias("e"), F.col("depth").alias("f"), "sha")
    out = nodes.join(ends, (F.col("conv_id") == F.col("e")) & (F.col("depth") == F.col("f")), "left")
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(df: DataFrame, group: int | None = None, most: int = 9) -> DataFrame:
    """The trie of a table (conv_id, turn, role, text); with ``group``, of conversations
    rebuilt by ``shared_beginnings``."""
    turns = turns_of(df)
    return trie(*(whole(turns) if group is None else shared_beginnings(turns, group, most)))
