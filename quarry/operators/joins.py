"""Joins and set operations (JON-01..07, SET-01..07).

The physical join is left to Catalyst and AQE: no side is hinted here, so a
broadcast only ever follows from sizes that Spark has measured
(``autoBroadcastJoinThreshold``), and skewed partitions are split at run time.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def measured_broadcast(table: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint for a small table that is already written or checkpointed,
    if the bytes of its rows, summed over the rows themselves, are within
    ``max_bytes``; otherwise the table as it is (the join shuffles).

    Only for tables whose scan is cheap: the sum reads the table once."""
    width = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) + 16 for f in table.schema.fields]
    size = table.agg(F.sum(sum(width, F.lit(16)))).first()[0] or 0
    return F.broadcast(table) if size <= max_bytes else table


# JON-01 ---------------------------------------------------------------------
def output_join(left: DataFrame | None, right: DataFrame | None, on: Sequence[str], how: str = "left",
                suffix: str = "_right") -> DataFrame | None:
    """Join two output tables on a column list.

    Left missing -> None (empty); right missing or no common key -> left.
    Non-key name clashes on the right get ``suffix``; a full join coalesces keys.
    """
    if left is None:
        return None
    if right is None:
        return left
    keys = [k for k in on if k in left.columns and k in right.columns]
    if not keys:
        return left
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in keys}
    right = right.withColumnsRenamed(clash) if clash else right
    how = {"outer": "full", "full_outer": "full"}.get(how, how)
    return left.join(right, on=keys, how=how)


# JON-02 ---------------------------------------------------------------------
def join_with_subset(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "left",
                     columns: Sequence[str] | None = None, suffix: str = "_joined", null_safe: bool = False) -> DataFrame:
    """Join on differently named keys, take a column subset from the right,
    rename clashing right columns with ``suffix``; both keys are kept."""
    keep = [right_on] + [c for c in (columns or right.columns) if c != right_on and c in right.columns]
    r = right.select(*keep)
    ren = {c: f"{c}{suffix}" for c in r.columns if c in left.columns}
    r = r.withColumnsRenamed(ren) if ren else r
    rk = ren.get(right_on, right_on)
    cond = left[left_on].eqNullSafe(r[rk]) if null_safe else left[left_on] == r[rk]
    how = {"outer": "full"}.get(how, how)
    return left.join(r, cond, how)


# JON-04 ---------------------------------------------------------------------
def semi_join(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def anti_join(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


# SET-01 / 02 / 03 -------------------------------------------------------------
def union_diagonal(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; missing columns are null; a type conflict becomes string."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("nothing to union")
    types: dict[str, set] = {}
    for f in frames:
        for fld in f.schema.fields:
            types.setdefault(fld.name, set()).add(fld.dataType.simpleString())
    conflict = {n for n, ts in types.items() if len(ts) > 1 and not _numeric_family(ts)}
    if conflict:
        log.warning("type conflict in union for %s; cast to string", sorted(conflict))
        frames = [f.withColumns({c: F.col(c).cast("string") for c in conflict if c in f.columns}) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _numeric_family(ts: set) -> bool:
    nums = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return ts <= nums


def combine_tagged(tables: Mapping[str, DataFrame], tag: str = "__table_id__") -> DataFrame:
    return union_diagonal([df.withColumn(tag, F.lit(name)) for name, df in tables.items()])


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    return union_diagonal(frames)


# SET-04 ---------------------------------------------------------------------
def concat_columns(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str],
                   suffix: str = "_right") -> DataFrame:
    """Positional column concat made key-based: each side gets its row position
    under an explicit order, then the sides are full-joined on the position."""
    lpos = row_position(left, left_order)
    ren = {c: f"{c}{suffix}" for c in right.columns if c in left.columns}
    rpos = row_position(right.withColumnsRenamed(ren), right_order)
    return lpos.join(rpos, "__pos", "full").drop("__pos")


def row_position(df: DataFrame, order: Sequence[str], name: str = "__pos") -> DataFrame:
    """1-based position of each row under ``order`` without a single-task window.

    A range-partitioned sort gives ordered partitions; a per-partition count
    (one row per partition) gives each partition's offset; the position is the
    offset plus the rank inside the partition.  Order keys must be unique."""
    sorted_df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = sorted_df.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    # offsets has one row per partition: broadcasting it is bounded by the partition count
    return (tagged.join(F.broadcast(offsets.select("__pid", "__off", "__first")), "__pid")
            .withColumn(name, F.col("__off") + (F.col("__mid") - F.col("__first")) + 1)
            .drop("__pid", "__mid", "__off", "__first"))


# SET-06 ---------------------------------------------------------------------
def dedup_keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Keep the first row per key by ``order``; returns (kept, one row of total / kept / dropped).

    ``min_by`` over the whole row has a map-side partial aggregate, so a hot key
    is one row a mapper, where a ``row_number`` window would sort it in one task.
    Spark plans it as a sort aggregate (the row is no fixed-width buffer)."""
    others = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*others), F.struct(*order)) if others else F.first(F.lit(True))
    grouped = df.groupBy(*key).agg(first.alias("__r"))
    kept = grouped.select(*key, *[F.col(f"__r.{c}").alias(c) for c in others])
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kept"))
    return kept, counts.withColumn("dropped", F.col("total") - F.col("kept"))


# SET-07 ---------------------------------------------------------------------
def append_with_defaults(target: DataFrame, rows: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Append rows from an older schema; missing columns get the defaults."""
    fill = {}
    for fld in target.schema.fields:
        if fld.name not in rows.columns:
            d = defaults.get(fld.name)
            fill[fld.name] = F.lit(d).cast(fld.dataType) if d is not None else F.lit(None).cast(fld.dataType)
    rows = rows.withColumns(fill) if fill else rows
    return target.unionByName(rows.select(*target.columns))


def three_way(chunks: DataFrame, embeddings: DataFrame, documents: DataFrame, chunk_key: str, doc_key: str) -> DataFrame:
    """JON-05: chunks ⨝ embeddings ⨝ documents (join order chosen by Catalyst)."""
    return chunks.join(embeddings, chunk_key).join(documents, doc_key)


def double_lookup(edges: DataFrame, src_types: DataFrame, dst_types: DataFrame, src: str = "src",
                  dst: str = "dst") -> DataFrame:
    """JON-06: edges with a left lookup for each endpoint (two aliased joins)."""
    return edges.join(src_types, src, "left").join(dst_types, dst, "left")


def string_type(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)
