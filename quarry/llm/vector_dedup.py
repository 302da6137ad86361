"""Embedding near-dedup by NN-descent.

Equal vectors of a label are one node.  A forest of random projections gives
each node a first list of neighbours; then rounds join the neighbours of each
node with each other and keep the nearest.  Links at the threshold form
components as the rounds go on.  A list saturated with links would hide further
ones, so a node keeps two lists: neighbours inside its component and outside it.
What is linked makes room, and outside lists take neighbours until a round brings
nothing new.  The recall is then audited by brute force for a sample of nodes
against all; if it is too low, lists are enlarged and rounds go on.  In the end every component is compared with itself exactly, in blocks, so a
node's links are complete within its component however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import components, write_table

THRESHOLD, NEIGHBOURS, TREES, LEAF, BLOCK = 0.93, 10, 6, 200, 2048
AUDIT_ROWS, AUDIT_RECALL, LEAST_RECALL, MARGIN, MAX_ROUNDS = 200, 0.98, 0.9, 0.05, 24
MOST_AUDITED = 16_384
_ROWS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])
_ROWS_DDL = "u long, v long, sim double"


def _unit(blobs: list[bytes], kind: str) -> np.ndarray:
    """Rows of unit length, in double precision."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _batch(u, v, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64)), pa.array(np.asarray(sim, np.float64))], schema=_ROWS)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[list[list]]:
    """Columns of the runs of rows that agree on the first ``keys`` columns, in stretches of at most ``most`` rows."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != now or len(rows) >= most:
                if rows:
                    yield list(zip(*rows))
                rows = []
                now = row[:keys]
            rows.append(row)
    if rows:
        yield list(zip(*rows))


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, str]:
    """(id, group, copies, vec) for each distinct usable vector of a label, and the vectors' number type.

    Usable: id, label and vector not null, not empty, all components finite, not all zero.
    The group is the label and the dimension: vectors of different dimensions never link.
    """
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    v = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v")).where(fine)
    schema = pa.schema([("id", pa.int64()), ("group", pa.string()), ("vec", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = [np.asarray(a, kind) + np.zeros(1, kind) for a in b.column(2).to_pylist()]  # -0 becomes 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"{g}/{len(a)}" for g, a in zip(b.column(1).to_pylist(), x)], pa.string()),
                                              pa.array([a.tobytes() for a in x], pa.binary())], schema=schema)

    packed = rows.mapInArrow(pack, "id long, group string, vec binary")
    return packed, kind


def _forest(nodes: DataFrame, kind: str, k: int, trees: int, leaf: int, seed: int, parts: int) -> DataFrame:
    """First neighbours: exact ones within the leaves of random-projection trees."""
    sizes = nodes.groupBy("group").agg(F.count("*").alias("of"))
    rows = nodes.join(sizes, "group").select("id", "group", "vec", F.ceil(F.log2(F.greatest(F.col("of") / leaf, F.lit(1.0)))).cast("int").alias("bits"))
    schema = pa.schema([("leaf", pa.string()), ("place", pa.float64()), ("id", pa.int64()), ("vec", pa.binary())])

    def plant(batches: Iterator[pa.RecordBatch]):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            ids, groups, vecs, bits = (c.to_pylist() for c in b.columns)
            for dim in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == dim]
                x = _unit([vecs[i] for i in at], kind)
                for t in range(trees):
                    if (dim, t) not in planes:
                        planes[dim, t] = np.random.default_rng([seed, t, dim]).normal(size=(x.shape[1], 49))
                    p = x @ planes[dim, t]
                    sign = p[:, 1:] > 0
                    leaves = [f"{groups[i]}/{t}/" + "".join("01"[x] for x in sign[j, :min(bits[i], 48)].tolist()) for j, i in enumerate(at)]
                    yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.string()), pa.array(p[:, 0]), pa.array([ids[i] for i in at], pa.int64()), pa.array([vecs[i] for i in at], pa.binary())], schema=schema)

    def near(batches: Iterator[pa.RecordBatch]):
        for _, _, ids, vecs in _grouped(batches, 1, 2 * leaf):  # a leaf that many near copies share is cut along its first projection
            if len(ids) > 1:
                x, ids = _unit(list(vecs), kind), np.array(ids)
                s = x @ x.T
                np.fill_diagonal(s, -2)
                best = np.argpartition(-s, min(k, len(ids) - 1) - 1, axis=1)[:, :min(k, len(ids) - 1)]
                yield _batch(np.repeat(ids, best.shape[1]), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel())

    planted = rows.mapInArrow(plant, "leaf string, place double, id long, vec binary")
    return planted.repartition(parts, "leaf").sortWithinPartitions("leaf", "place").mapInArrow(near, _ROWS_DDL)


def _refined(rows: DataFrame, comp: DataFrame | None, k: int) -> DataFrame:
    """The nearest ``k`` inside the component and ``k`` outside of each u: u, v, sim, fresh, inside."""
    rows = rows.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    if comp is None:
        rows = rows.withColumn("inside", F.lit(False))
    else:
        rows = rows.join(comp.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(
            comp.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left").withColumn("inside", F.coalesce(F.col("cu") == F.col("cv"), F.lit(False))).drop("cu", "cv")
    w = Window.partitionBy("u", "inside").orderBy(F.desc("sim"), "v")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("u", "v", "sim", "fresh", "inside")


def _joined_neighbours(lists: DataFrame, nodes: DataFrame, comp: DataFrame | None, kind: str, k: int, parts: int, turn: int) -> DataFrame:
    """Pairs of neighbours of one node, at least one of them fresh, of different components, that would enter an outside list."""
    both = lists.select(F.col("u").alias("center"), F.col("v").alias("id"), "fresh").unionByName(lists.select(F.col("v").alias("center"), F.col("u").alias("id"), "fresh"))
    both = both.groupBy("center", "id").agg(F.max("fresh").alias("fresh"))
    both = both.join(both.where("fresh").select("center").distinct(), "center", "left_semi")
    bound = lists.where("NOT inside").groupBy(F.col("u").alias("id")).agg(F.when(F.count("*") >= k, F.min("sim")).alias("bound"))
    info = nodes.select("id", "vec").join(bound, "id", "left")
    info = info.join(comp.select(F.col("node").alias("id"), "component"), "id", "left") if comp is not None else info.withColumn("component", F.lit(None).cast("long"))
    rows = both.join(info, "id").select("center", "id", "fresh", "vec", F.coalesce("bound", F.lit(-2.0)).alias("bound"), F.coalesce("component", "id").alias("component"))

    def pairs(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        # a node that very many lists hold is joined in stretches, which are dealt anew in each round
        for _, ids, fresh, vecs, bound, component in _grouped(batches, 1, 256):
            if len(ids) > 1 and any(fresh):
                x, ids, fresh, bound, component = _unit(list(vecs), kind), np.array(ids), np.array(fresh), np.array(bound), np.array(component)
                s = x @ x.T
                u, v = np.nonzero((s > bound[:, None]) & (fresh[:, None] | fresh[None, :]) & (component[:, None] != component[None, :]))
                # of a node's finds here only as many as its list could take
                order = np.lexsort((-s[u, v], u))
                u, v = u[order], v[order]
                start = np.searchsorted(u, u)
                keep = np.arange(len(u)) - start < k
                held.append((ids[u[keep]], ids[v[keep]], s[u[keep], v[keep]]))
                n += int(keep.sum())
            if n > 500_000:
                yield _unique(held)
                held, n = [], 0
        if n:
            yield _unique(held)

    def _unique(held):
        u, v, s = (np.concatenate(c) for c in zip(*held))
        _, first = np.unique(np.stack([u, v], 1), axis=0, return_index=True)
        return _batch(u[first], v[first], s[first])

    return rows.repartition(parts, "center").sortWithinPartitions("center", F.xxhash64(F.lit(turn), "id"), "id").mapInArrow(pairs, _ROWS_DDL)


def audit(nodes: DataFrame, lists: DataFrame, comp: DataFrame, kind: str, threshold: float, rows: int, block: int = BLOCK, margin: float = MARGIN) -> tuple[float, float]:
    """Of the nodes that have true links, the share whose every link lies within the component: an estimate and its lower bound (95 %).

    About ``rows`` nodes of each of three strata, by a hash of the id: those with a found link, those whose best
    found neighbour lies less than ``margin`` below the threshold, and the others.  Each is compared with
    all nodes of its group, in blocks.  Strata count by their sizes.  Where fewer than ``rows`` linked nodes were seen
    the others are sampled on, up to ``MOST_AUDITED``: the work grows with the nodes, not with their square.  Where no node of the sample has a link the estimate is 1, and the bound says what the sample can: a stratum of n
    nodes without one among m holds less than 3 n / m linked ones.
    """
    scale, parts = 1 << 30, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = lists.groupBy(F.col("u").alias("id")).agg(F.max("sim").alias("best"))
    stratum = F.when(F.col("best") >= threshold, 0).when(F.col("best") >= threshold - margin, 1).otherwise(2)
    inside = nodes.select("id", "group", "vec").join(comp.select(F.col("node").alias("id"), "component"), "id", "left").join(best, "id", "left")
    inside = write_table(inside.select("id", "group", "vec", F.coalesce("component", "id").alias("component"), stratum.alias("stratum"), F.pmod(F.xxhash64(F.lit(rows), "id"), F.lit(scale)).alias("at")), "audit")
    sizes = {r["stratum"]: r["n"] for r in inside.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("outside", pa.int64())])

    def links(batches: Iterator[pa.RecordBatch]):
        for _, _, _, sampled, ids, component, vecs in _grouped(batches, 3, 2 ** 62):  # two blocks at most
            x, sampled, ids, component = _unit(list(vecs), kind), np.array(sampled), np.array(ids), np.array(component)
            q, n = sampled, ~sampled
            s = (x[q] @ x[n].T >= threshold) & (ids[q][:, None] != ids[n][None, :])
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(s.sum(axis=1)), pa.array((s & (component[q][:, None] != component[n][None, :])).sum(axis=1))], schema=schema)

    def blocks(of: DataFrame, name: str) -> DataFrame:
        return of.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    def deal(of: DataFrame, own: str, other: str, counts: DataFrame, sampled: bool) -> DataFrame:
        """Each row with its block among its own kind and every block of the other kind."""
        return of.join(counts, "group").withColumn(own, F.pmod(F.xxhash64(F.lit(1), "id"), F.col(f"n_{own}")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).select("group", "i", "j", F.lit(sampled).alias("sampled"), "id", "component", "vec")

    seen: dict[int, list[int]] = {k: [0, 0, 0] for k in sizes}  # compared, linked, good
    done = dict.fromkeys(sizes, 0)  # of the hash's range
    target = dict.fromkeys(sizes, rows)
    while True:
        upto = {k: min(scale, -(-scale * target[k] // sizes[k])) for k in sizes}
        fits = [(F.col("stratum") == k) & (F.col("at") >= done[k]) & (F.col("at") < upto[k]) for k in sizes]
        if not fits:
            break
        sample = inside.where(reduce(lambda x, y: x | y, fits))
        counts = blocks(sample, "n_i").join(blocks(inside, "n_j"), "group")
        pairs = deal(sample, "i", "j", counts, True).unionByName(deal(inside, "j", "i", counts, False))
        found = pairs.repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(links, "id long, links long, outside long").groupBy("id").agg(
            F.sum("links").alias("links"), F.sum("outside").alias("outside"))
        for r in found.join(sample.select("id", "stratum"), "id").groupBy("stratum").agg(
                F.count("*").alias("n"), F.count_if(F.col("links") > 0).alias("linked"), F.count_if((F.col("links") > 0) & (F.col("outside") == 0)).alias("good")).collect():
            seen[r["stratum"]] = [x + y for x, y in zip(seen[r["stratum"]], (r["n"], r["linked"], r["good"]))]
        done = upto
        # the others are sampled on where few links were seen, up to a bound
        if sum(l for _, l, _ in seen.values()) >= rows or 2 not in sizes or done[2] >= scale or target[2] >= MOST_AUDITED:
            break
        target[2] = min(3 * target[2], MOST_AUDITED)
    return _estimate([(sizes[k], n, l, g) for k, (n, l, g) in seen.items() if n])


def _estimate(strata: list[tuple[int, int, int, int]]) -> tuple[float, float]:
    """(size, sampled, linked, good) by stratum: the share of good ones among the linked, and a lower bound of it."""
    linked = sum(size * l / n for size, n, l, _ in strata)
    good = sum(size * g / n for size, n, _, g in strata)
    if not linked:
        return 1.0, 1.0
    share = good / linked
    # variance of the ratio, from each stratum's sample (all of a stratum sampled: none)
    spread = sum(size * size * (1 - n / size) / n * max(0.0, (g * (1 - share) ** 2 + (l - g) * share ** 2) / n) for size, n, l, g in strata)
    return share, max(0.0, share - 1.645 * spread ** 0.5 / linked)


def _counted(nodes: DataFrame, comp: DataFrame, kind: str, threshold: float, block: int, parts: int) -> DataFrame:
    """(id, links): copies of other nodes linked to each node, exactly, within components; blocks pair by pair."""
    members = nodes.join(comp.select(F.col("node").alias("id"), "component"), "id")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, part).alias("i"), F.greatest(j, part).alias("j")))
    dealt = members.join(sizes, "component").select("component", F.explode(pairs).alias("p"), part.alias("part"), "id", "copies", "vec").select("component", "p.i", "p.j", "part", "id", "copies", "vec")
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]):
        for _, i, j, part, ids, copies, vecs in _grouped(batches, 3, 2 ** 62):  # two blocks at most
            x, part, ids, copies = _unit(list(vecs), kind), np.array(part), np.array(ids), np.array(copies)
            a, b = part == i[0], part == j[0]
            s = x[a] @ x[b].T >= threshold
            if i[0] == j[0]:
                np.fill_diagonal(s, False)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(s @ copies)], schema=schema)
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[a], ids[b]])), pa.array(np.concatenate([s @ copies[b], s.T @ copies[a]]))], schema=schema)

    return dealt.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, audit_rows: int = AUDIT_ROWS, recall: float = AUDIT_RECALL) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links (other rows linked directly), component_id (smallest id reachable, itself included), kept.

    Links: equal labels and a cosine of at least ``threshold`` in double
    precision.  Rows whose id, label or vector is null, or whose vector is empty,
    zero or has null or non-finite components, link with nothing (component: the
    own id).  Rows that repeat an id are rows of their own in n_links.  Other columns
    are not read.  Lists are enlarged until the audited recall is reached (its estimate ``recall``, its lower bound ``LEAST_RECALL``);
    raises only if lists as long as the table do not reach it.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed, kind = nodes_of(vectors, id_col, vector_col, label_col)
    packed = write_table(packed, "vectors")
    same = ["group", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")]
    nodes = write_table(packed.groupBy(*same).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vec").alias("vec")).select("id", "group", "h1", "h2", "copies", "vec"), "nodes")
    # an id that two different vectors share cannot name two nodes
    nodes = nodes if nodes.groupBy("id").count().where("count > 1").isEmpty() else write_table(
        nodes.withColumn("first", F.col("id")).withColumn("id", F.xxhash64("id", "group", "h1", "h2")), "nodes")
    k, seed, turn, comp = neighbours, 1, 0, None
    rows = _forest(nodes, kind, k, trees, leaf, seed, parts).withColumn("fresh", F.lit(True))
    lists = write_table(_refined(rows, None, k), "lists")
    links = lists.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
    comp = write_table(components(links), "components")
    lists = write_table(_refined(lists.drop("inside"), comp, k), "lists")
    total, settled = nodes.count(), 0
    while True:
        turn += 1
        found = write_table(_joined_neighbours(lists, nodes, comp, kind, k, parts, turn), "found")
        new = found.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
        if not new.isEmpty():
            comp = write_table(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new)), "components")
        lists = write_table(_refined(lists.withColumn("fresh", F.lit(False)).drop("inside").unionByName(found.withColumn("fresh", F.lit(True))), comp, k), "lists")
        if lists.where("fresh").isEmpty() or turn - settled >= MAX_ROUNDS:  # lists that go on changing are held to the same audit
            share, low = audit(nodes, lists, comp, kind, threshold, audit_rows, block)
            if share >= recall and low >= LEAST_RECALL:
                break
            if k >= total:
                raise RuntimeError("the audited recall of links was not reached")
            # enlarge: longer lists, started anew by other trees
            k, seed, settled = 2 * k, seed + 1, turn
            more = _forest(nodes, kind, k, trees, 2 * leaf, seed, parts).withColumn("fresh", F.lit(True))
            links = more.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
            comp = write_table(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "components")
            lists = write_table(_refined(lists.drop("inside").unionByName(more), comp, k), "lists")

    counted = _counted(nodes, comp, kind, threshold, block, parts)
    first = F.col("first") if "first" in nodes.columns else F.col("id")
    table = nodes.join(counted, "id", "left").join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select(
        "group", "h1", "h2", first.alias("first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    lowest = table.groupBy("component").agg(F.min("first").alias("component_id"))
    table = table.join(lowest, "component").select("group", "h1", "h2", "n_links", "component_id")
    usable = packed.select(F.col("id").alias("vec_id"), *same).join(table, ["group", "h1", "h2"]).groupBy("vec_id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(usable, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
