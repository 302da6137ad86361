"""Helpers shared by the operators: shared folder, worker state, components."""

from __future__ import annotations

import gc
import os
import sys
import types
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

#: Upper- to lower-case letters A-Z, the only ones that the contracts fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of the contracts: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh sub-folder of the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def mounted(uri: str) -> str:
    """The path at which driver and executors see a shared folder as files."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need spark.checkpoint.dir on a shared mount, not {uri}")
    return os.path.normpath(parts.path)


def write_table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark, uri = df.sparkSession, shared_folder(df.sparkSession, name)
    schema = df.schema
    (df.write.option("compression", compression) if compression else df.write).parquet(uri)
    return spark.read.schema(schema).parquet(uri)


BROADCAST_ROWS = 1_000_000


def bounded_broadcast(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (a few numbers each), written, and broadcast if they are few; beyond that the join shuffles."""
    rows = write_table(rows, "ids")
    return F.broadcast(rows) if rows.count() <= most else rows


BUCKET_BYTES = 256 * 1024 * 1024


def buckets_for(df: DataFrame) -> int:
    """Buckets that a task gathers one at a time: the session's shuffle partitions, and more where the
    input, by the planner's size of its files, would give a bucket over ``BUCKET_BYTES``."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # the planner's word for unknown is a huge number
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known // BUCKET_BYTES))


def worker_state(name: str, make):
    """An object that lives as long as the Python worker, over all its tasks.

    Names share a group by their first word; an object of another group drops those
    before it, so a worker that serves one operator after the other holds one's caches."""
    store = sys.modules.setdefault("_quarry_llm_state", types.ModuleType("_quarry_llm_state")).__dict__
    group = name.split(" ")[0]
    if store.get("group") != group:
        store.clear()
        store["group"] = group
        gc.collect()
        pa.default_memory_pool().release_unused()
    if name not in store:
        store[name] = make()
    return store[name]


def ascii_lower(col):
    """Lower-case A-Z only; the fast path serves all-ASCII values."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def text_ascii_lower(s: str) -> str:
    """Python twin of :func:`ascii_lower`."""
    return s.lower() if s.isascii() else s.encode().lower().decode()  # bytes fold A-Z alone


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: (node, component = smallest node).

    Large-star / small-star rounds until the edge list is a set of stars; each
    round is two shuffles of the edges, written to the shared folder.  A star
    centre that holds most edges only ever appears as a grouped minimum.
    Self-loops and repeated edges are harmless; nodes without edges do not
    appear.  Raises if the rounds do not converge (never returns a partial answer).
    """
    def directed(df):  # larger -> smaller, no loops
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    cur = write_table(directed(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "cc")
    for _ in range(max_rounds):
        # done when no edge ends where another begins: all are stars around their smallest node
        if cur.join(cur.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and cur.groupBy("u").count().where("count > 1").isEmpty():
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u points to the smallest of u's neighbourhood
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours point to the smallest of them
        large = write_table(directed(large), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                                  F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        cur = write_table(directed(small), "cc")
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
