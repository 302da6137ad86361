"""Prefix trie of conversations, with totals of its subtrees by centroid decomposition.

A node stands for a sequence of turns, named by 128 bits: the sum, in four lanes of
32 bits, of hashes of (depth, turn).  Sums of a conversation's prefix are running sums, so
they are taken in stretches of ``STRETCH`` turns and a long conversation is split.

Totals of subtrees: every component of the parent-edge forest that is heavier than ``BLOCK``
takes part in a round.  Its centroid is the deepest node whose part of it weighs more than
half; the total of the centroid's part is added to each node on the path from the centroid to the
component's top, and the component falls apart into the subtrees of the centroid's children and
what is left above.  A component's weight at least halves, so the number of rounds is the
logarithm of the trie's size.  Components within ``BLOCK`` end in one task each, by the same
decomposition.  The weight of a node is its number of members, so the weight of its subtree is a count
of rows that the grouping by node gives.

Paths are looked up, not walked: a node lies on the path of its smallest member, so its
ancestor at any depth is that conversation's row of that depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_broadcast, buckets_for, write_table
from quarry.llm.conversations import BLOB, digest_in_order, range_sorted, turn_key

STRETCH = 4096
#: Weight of a component that one task decomposes.
BLOCK = 4096
#: Conversations take over the first turns of the one whose id is the hundred below; at most so many.
FAMILY, MOST_SHARED = 100, 5
_ROOT = "named_struct('a', 0L, 'b', 0L)"
_LOW = 0xFFFFFFFF


def number_turns(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, key, chars) of non-null conversations with ``at``, their place from 0 (null turns first, ties by key)."""
    def run(batches: Iterator[pa.RecordBatch]):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv = b.column("conv_id").to_numpy()
            if not len(conv):
                continue
            begins = np.flatnonzero(np.concatenate(([last is None or conv[0] != last], conv[1:] != conv[:-1])))
            at = np.arange(len(conv))
            first = np.zeros(len(conv), np.int64)
            first[begins] = begins
            at = at - np.maximum.accumulate(first)
            head = begins[0] if len(begins) else len(conv)
            at[:head] += seen
            seen, last = int(at[-1]) + 1, conv[-1]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("key"), b.column("chars"), pa.array(at), pa.array(np.full(len(conv), part, np.int32))],
                                             names=["conv_id", "key", "chars", "at", "part"])

    placed = write_table(range_sorted(turns.select("conv_id", "turn", "key", "chars"), ("conv_id", "turn", "key")).mapInArrow(
        run, "conv_id long, key binary, chars long, at long, part int"), "turns")
    # conversations that go on in the next partition: two a partition at most
    ends = placed.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).select(F.explode(F.array("low", "high")).alias("conv_id")).distinct()
    counts = placed.join(F.broadcast(ends), "conv_id").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = bounded_broadcast(counts.withColumn("before", F.sum("n").over(before)).where("before > 0").select("conv_id", "part", "before"))
    return placed.join(shift, ["conv_id", "part"], "left").select("conv_id", "key", "chars", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"))


def rebuild(rows: DataFrame) -> DataFrame:
    """Conversations that begin as others do: conv_id, depth (from 1), key, chars, turns (of the rebuilt conversation); depth 0 once each.

    Conversation c begins with the first h turns of conversation c - c % 100 (all if it has fewer, none if
    it is absent), h being the CRC-32 of c's digits modulo 6; its own turns after its first h follow."""
    empty = F.lit("")
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                                    F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    placed = write_table(number_turns(turns.select("conv_id", "turn", turn_key(F.col("role"), F.col("text")).alias("key"), F.char_length("text").cast("long").alias("chars"))), "placed")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = placed.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", base)
    heads = own.where("conv_id = base").select("base", F.least("n", F.lit(MOST_SHARED)).alias("most"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    plan = own.withColumn("h", shared).join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("most", F.lit(0))))
    plan = write_table(plan.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")), "plan")
    first = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    begun = plan.join(first, "base").where("at < taken").select("conv_id", (F.col("at") + 1).alias("depth"), "key", "chars", "turns")
    rest = placed.join(plan, "conv_id").where("at >= h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h") + 1).alias("depth"), "key", "chars", "turns")
    tops = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"), "turns")
    return begun.unionByName(rest).unionByName(tops)


def name_prefixes(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, depth, key, chars, turns) with node and parent: the names of their prefix and of the one before it (null at depth 0). Written."""
    whole = [F.xxhash64("depth", "key"), F.xxhash64("key", "depth")]
    lanes = {f"l{2 * k + j}": F.shiftrightunsigned(h, 32) if j else h.bitwiseAND(F.lit(_LOW)) for k, h in enumerate(whole) for j in (0, 1)}
    stretched = turns.where("depth > 0").withColumns(lanes).withColumn("stretch", F.floor((F.col("depth") - 1) / STRETCH))
    w = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = stretched.withColumns({f"s{k}": F.sum(f"l{k}").over(w) for k in range(4)})
    later = stretched.where(F.col("turns") > STRETCH).groupBy("conv_id", "stretch").agg(*[F.sum(f"l{k}").alias(f"t{k}") for k in range(4)])
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    later = bounded_broadcast(later.withColumns({f"t{k}": F.sum(f"t{k}").over(before) for k in range(4)}).where("stretch > 0"))

    def name(minus):
        lane = [(F.col(f"s{k}") + F.coalesce(f"t{k}", F.lit(0)) - (F.col(f"l{k}") if minus else 0)).bitwiseAND(F.lit(_LOW)) for k in range(4)]
        return F.struct(*[lane[2 * k].bitwiseOR(F.shiftleft(lane[2 * k + 1], 32)).alias(c) for k, c in enumerate("ab")])

    deep = sums.join(later, ["conv_id", "stretch"], "left").select("conv_id", "depth", "chars", "turns", name(False).alias("node"), name(True).alias("parent"))
    tops = turns.where("depth = 0").select("conv_id", "depth", "chars", "turns", F.expr(_ROOT).alias("node"), F.expr(f"IF(false, {_ROOT}, NULL)").alias("parent"))
    return write_table(deep.unionByName(tops), "paths")


# ---------------------------------------------------------------- totals of subtrees
def decompose(parents: list[int], values: list[tuple]) -> list[list]:
    """Totals of the subtrees of one component, whose nodes stand after their parents (the first is the top), by its centroids."""
    totals = [[0] * len(v) for v in values]
    where, size, number = [0] * len(parents), [0] * len(parents), 0
    stack = [list(range(len(parents)))]
    while stack:
        members = stack.pop()
        here, top = where[members[0]], members[0]
        for i in members:
            size[i] = 1
        for i in reversed(members):
            if i != top:
                size[parents[i]] += size[i]
        centroid = next(i for i in reversed(members) if 2 * size[i] > len(members))
        found, above = {}, []
        total = list(values[centroid])
        for i in members:
            if i == centroid:
                continue
            p = parents[i]
            if p == centroid:
                number += 1
                where[i] = number
                found[number] = [i]
            elif i != top and where[p] != here:
                where[i] = where[p]
                found[where[i]].append(i)
            else:
                above.append(i)
                continue
            total = [a + b for a, b in zip(total, values[i])]
        i = centroid
        while True:  # from the centroid to the top
            totals[i] = [a + b for a, b in zip(totals[i], total)]
            if i == top:
                break
            i = parents[i]
        stack += found.values()
        if above:
            stack.append(above)
    return totals


def _decompose_blocks(values: list[str]):
    def run(batches: Iterator[pa.RecordBatch]):
        def solve(rows):
            index = {r[1:3]: i for i, r in enumerate(rows)}
            parents = [index.get(r[3:5], -1) for r in rows]
            return zip([r[1] for r in rows], [r[2] for r in rows], *zip(*decompose(parents, [r[5:] for r in rows])))

        at, rows, out = None, [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != at:
                    if rows:
                        out += solve(rows)
                    at, rows = row[0], []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", *values])
                out = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*solve(rows))], names=["a", "b", *values])

    return run


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """Sums of ``values`` over each node's subtree (its top included): node and the sums.

    ``nodes``: node, parent (null at a top), depth, conv_id, weight (of its subtree, over that of each child), tree (its top) and the values;
    ``paths``: conv_id, depth, node, parent -- all ancestors of a node are rows of the node's conv_id."""
    state, adds, small = write_table(nodes.select("node", "parent", "depth", "conv_id", "weight", F.col("tree").alias("part"), *values), "trie-nodes"), [], []
    while True:
        heavy = write_table(state.groupBy("part").agg(F.max("weight").alias("whole")).where(F.col("whole") > block), "heavy")
        if heavy.isEmpty():
            small.append(state)
            break
        marked = state.join(bounded_broadcast(heavy), "part", "left")
        small.append(marked.where("whole IS NULL").drop("whole"))
        big = marked.where("whole IS NOT NULL")
        # of each component: the centroid, its depth and that of the top
        centroids = big.where("2 * weight > whole").groupBy("part").agg(F.min(F.struct("weight", "depth", "node", "conv_id")).alias("c"), F.min("depth").alias("top"))
        centroids = bounded_broadcast(centroids.select("part", "top", F.col("c.depth").alias("at"), F.col("c.node").alias("centroid"), F.col("c.conv_id").alias("along"), F.col("c.weight").alias("less")))
        placed = big.join(centroids, "part")
        # the ancestor just below the centroid's depth, once for each chain of a component
        ask = placed.where("depth > at").select("part", "conv_id", (F.col("at") + 1).alias("depth"), "centroid").distinct()
        under = ask.join(paths.select("conv_id", "depth", F.col("node").alias("child"), F.col("parent").alias("above")), ["conv_id", "depth"]).where("above = centroid").select("part", "conv_id", "child")
        split = placed.join(under, ["part", "conv_id"], "left").withColumn("child", F.when(F.col("depth") > F.col("at"), F.col("child")))
        split = write_table(split.select("node", "parent", "depth", "conv_id", "weight", "part", "child", (F.col("node") == F.col("centroid")).alias("is_centroid"), *values), "split")
        totals = split.where("child IS NOT NULL OR is_centroid").groupBy("part").agg(*[F.sum(v).alias(v) for v in values])
        along = centroids.join(totals, "part").withColumnRenamed("along", "conv_id")
        path = paths.select("conv_id", "depth", "node").join(bounded_broadcast(along), "conv_id").where("depth BETWEEN top AND at")
        path = write_table(path.select("node", "less", *values), "centroid-paths")
        adds.append(path.select("node", *values))
        below = split.where("child IS NOT NULL").withColumn("part", F.col("child"))
        rest = split.where("child IS NULL AND NOT is_centroid").join(path.select("node", "less"), "node", "left").withColumn("weight", F.col("weight") - F.coalesce("less", F.lit(0)))
        keep = ["node", "parent", "depth", "conv_id", "weight", "part", *values]
        state = write_table(below.select(*keep).unionByName(rest.select(*keep)), "trie-nodes")
    blocks = reduce(DataFrame.unionByName, small)
    flat = blocks.select("part", "depth", "node", "parent", *values).repartition(buckets_for(state), "part").sortWithinPartitions("part", "depth").select(
        F.concat(F.col("part.a").cast("string"), F.lit(" "), F.col("part.b").cast("string")).alias("part"), "node.a", "node.b", F.col("parent.a").alias("pa"), F.col("parent.b").alias("pb"), *values)
    solved = flat.mapInArrow(_decompose_blocks(values), ", ".join(f"{c} long" for c in ["a", "b", *values])).select(F.struct("a", "b").alias("node"), *values)
    return reduce(DataFrame.unionByName, adds, solved).groupBy("node").agg(*[F.sum(v).alias(v) for v in values])


# ---------------------------------------------------------------- the operator
def _member_blobs(batches: Iterator[pa.RecordBatch]):
    """Runs of one node's members, sorted: comma-joined blobs with their first member."""
    node, ids, size = None, [], 0
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    for b in batches:
        out = []
        for this, conv in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist()):
            if ids and (this != node or size > BLOB):
                out.append((node, ids[0], 0, ",".join(map(str, ids)).encode()))
                ids, size = [], 0
            node = this
            ids.append(conv)
            size += len(str(conv)) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.int32(), pa.binary()))], names=["node", "first", "slice", "blob"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([node], kind), pa.array([ids[0]]), pa.array([0], pa.int32()), pa.array([",".join(map(str, ids)).encode()])], names=["node", "first", "slice", "blob"])


def prefix_trie(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The trie of conversations (conv_id, depth, key, chars, turns; depth 0 once each) and their paths.

    Nodes: node, conv_id (smallest member), depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.
    Paths: conv_id, depth, node, parent, turns.  An empty table has no root and gives no rows."""
    paths = name_prefixes(turns)
    nodes = write_table(paths.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("chars").alias("chars"),
                                                 F.count("*").alias("n_convs"), F.sum(F.col("turns") - F.col("depth") + 1).alias("weight")), "nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = write_table(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "nodes")
    worth = nodes.withColumns({"tree": F.expr(_ROOT), "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    totals = subtree_totals(worth, paths, ["n_leaves", "saved_tokens"], block)
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(totals, "node").join(above, "parent", "left").drop("chars", "weight"), paths


def member_digests(paths: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids of the conversations that end at a node, ascending: node, sha256."""
    ends = paths.where("depth = turns").select("node", "conv_id")
    blobs = range_sorted(ends, ("node", "conv_id")).mapInArrow(_member_blobs, "node struct<a:bigint,b:bigint>, first long, slice int, blob binary")
    return digest_in_order(blobs, "node", ("first",), b",")


def conversation_trie(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node of the trie of rebuilt conversations (see :func:`rebuild`): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Nulls of role and text are empty texts, null turns come first, turns of one number go by :func:`turn_key`;
    rows of a null conv_id belong to no conversation and are left out; repeated rows are turns of their own.
    Other columns are not read.  An empty table gives no rows."""
    nodes, paths = prefix_trie(rebuild(rows), block)
    out = nodes.join(member_digests(paths), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
