"""Reference graph and dataset lineage (GRF-01..04).

Traversals are iterative DataFrame joins.  A k-hop walk joins the frontier with the
edge table, removes already-seen nodes (``left_anti``) and stops when the
frontier is empty or the depth is reached; lineage, which may be deep, doubles its paths.  The driver only
loops over rounds; each one's nodes are checkpointed, so a round is computed once and
the plan does not grow with the depth.  A hub's edges are split by AQE's skew join.
"""

from __future__ import annotations

from collections.abc import Sequence

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir


def neighbors(edges: DataFrame, node, src: str = "src", dst: str = "dst") -> DataFrame:
    """GRF-01: edges touching ``node`` in either direction, with the other end."""
    e = edges.filter((F.col(src) == F.lit(node)) | (F.col(dst) == F.lit(node)))
    return e.withColumn("neighbor", F.when(F.col(src) == F.lit(node), F.col(dst)).otherwise(F.col(src))) \
        .withColumn("direction", F.when(F.col(src) == F.lit(node), "outgoing").otherwise("incoming"))


def _undirected(edges: DataFrame, src: str, dst: str) -> DataFrame:
    a = edges.select(F.col(src).alias("__from"), F.col(dst).alias("__to"))
    b = edges.select(F.col(dst).alias("__from"), F.col(src).alias("__to"))
    return a.unionByName(b).distinct()


def _walk(start: DataFrame, step: DataFrame, max_depth: int | None) -> DataFrame:
    """(node, depth): what ``step`` (__from, __to) reaches from the ``start`` nodes, with the least depth."""
    ensure_checkpoint_dir(start.sparkSession)
    step = step.checkpoint(eager=True)
    frontier = start.distinct().withColumn("depth", F.lit(0)).checkpoint(eager=True)
    seen = frontier
    for hop in count(1):
        if max_depth is not None and hop > max_depth:
            break
        reached = frontier.join(step, frontier["node"] == step["__from"]).select(F.col("__to").alias("node")).distinct()
        frontier = reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(hop)).checkpoint(eager=True)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier).checkpoint(eager=True)
    return seen


def k_hop(edges: DataFrame, seeds: DataFrame | Sequence, k: int, src: str = "src", dst: str = "dst",
          node_col: str = "node") -> DataFrame:
    """GRF-02: nodes within k undirected hops of the seed set, with their hop distance."""
    if not isinstance(seeds, DataFrame):
        seeds = edges.sparkSession.createDataFrame([(s,) for s in seeds], [node_col])
    start = seeds.select(F.col(node_col).alias("node"))
    return _walk(start, _undirected(edges, src, dst), k).withColumnRenamed("node", node_col)


def _reach(start: DataFrame, step: DataFrame, max_depth: int | None) -> DataFrame:
    """As :func:`_walk`, by path doubling: the depth takes its logarithm in rounds.

    In round k ``jumps`` holds the pairs that 2**k steps connect, and ``seen`` all that fewer than
    2**k steps reach, with the least number; jumping from there reaches what lies less than twice as far, and jumps
    joined with themselves are the next ones.  Least depths have no gaps, so a round without a new
    node is the last."""
    ensure_checkpoint_dir(start.sparkSession)
    jumps = step.distinct().checkpoint(eager=True)
    seen = start.distinct().withColumn("depth", F.lit(0)).checkpoint(eager=True)
    known = seen.count()
    for k in count():
        if max_depth is not None and 1 << k > max_depth:
            break
        far = seen.join(jumps, seen["node"] == jumps["__from"]).select(F.col("__to").alias("node"), (F.col("depth") + (1 << k)).alias("depth"))
        seen = seen.unionByName(far).groupBy("node").agg(F.min("depth").alias("depth")).checkpoint(eager=True)
        now = seen.count()
        if now == known:
            break
        known = now
        on = jumps.select(F.col("__from").alias("__to"), F.col("__to").alias("__next"))
        jumps = jumps.join(on, "__to").select("__from", F.col("__next").alias("__to")).distinct().checkpoint(eager=True)
    return seen if max_depth is None else seen.where(F.col("depth") <= max_depth)


def lineage(edges: DataFrame, start, direction: str = "down", max_depth: int | None = None,
            parent: str = "parent", child: str = "child") -> DataFrame:
    """GRF-03: ancestors (``up``), descendants (``down``) or both of a node or of several (a list,
    or a DataFrame's first column), each with its minimum depth, as far as they go unless ``max_depth`` says
    otherwise.  Cycles end, as a node's least depth is kept.  A depth d takes log2(d) rounds (:func:`_reach`)."""
    ways = {"down": (parent, child), "up": (child, parent)}
    if direction not in (*ways, "both"):
        raise ValueError(f"unknown direction {direction!r}")
    if isinstance(start, DataFrame):
        first = start.select(F.col(start.columns[0]).alias("node"))
    else:
        starts = list(start) if isinstance(start, (list, tuple, set)) else [start]
        first = edges.sparkSession.createDataFrame([(s,) for s in starts], "node " + edges.schema[parent].dataType.simpleString())
    parts = [_reach(first, edges.select(F.col(a).alias("__from"), F.col(b).alias("__to")), max_depth).where("depth > 0").withColumn("direction", F.lit(name))
             for name, (a, b) in ways.items() if direction in (name, "both")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def edges_from_parents(datasets: DataFrame, id_col: str = "id", parents_col: str = "parent_ids") -> DataFrame:
    """Lineage edges (parent, child) from a dataset catalogue with parent id arrays."""
    return datasets.select(F.explode(F.col(parents_col)).alias("parent"), F.col(id_col).alias("child"))


def edge_counts(edges: DataFrame, type_col: str) -> DataFrame:
    """GRF-04: edges per relation type."""
    return edges.groupBy(type_col).agg(F.count(F.lit(1)).alias("count"))
