"""Sorts, limits, paging, top-k and running totals (SRT-01..05, WIN-01).

``orderBy().limit(k)`` plans as TakeOrderedAndProject: every task keeps only
its own top k, so nothing unbounded reaches one task.  Running totals are
computed as a two-level prefix sum so a hot partition key is split across
range partitions instead of being sorted in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def preview(df: DataFrame, n: int, order_by: Sequence[str], columns: Sequence[str] | None = None,
            with_total: bool = True) -> tuple[DataFrame, int | None]:
    """First ``n`` rows by an explicit order (optional column subset) and the total row count."""
    total = df.count() if with_total else None
    rows = df.select(*columns) if columns else df
    rows = rows.orderBy(*order_by).limit(n)
    if with_total:
        rows = rows.withColumn("total_rows", F.lit(total).cast("bigint"))
    return rows, total


def preview_rows_for_size(file_bytes: int) -> int:
    """Preview size by file size: 10,000 up to 100 MB, 5,000 up to 1 GB, else 1,000."""
    if file_bytes <= 100 * 1024 * 1024:
        return 10_000
    if file_bytes <= 1024 * 1024 * 1024:
        return 5_000
    return 1_000


def cursor_page(df: DataFrame, sort_col: str, id_col: str, cursor_id=None, descending: bool = True,
                limit: int = 50) -> DataFrame:
    """Keyset page: rows strictly after the cursor row in (sort, id) order.
    An unknown cursor returns the first page."""
    order = [F.col(sort_col).desc(), F.col(id_col).desc()] if descending else [F.col(sort_col), F.col(id_col)]
    if cursor_id is not None:
        cur = df.filter(F.col(id_col) == F.lit(cursor_id)).select(sort_col).limit(1).collect()
        if cur:
            cv = cur[0][0]
            s, i = F.col(sort_col), F.col(id_col)
            if descending:
                df = df.filter((s < F.lit(cv)) | ((s == F.lit(cv)) & (i < F.lit(cursor_id))))
            else:
                df = df.filter((s > F.lit(cv)) | ((s == F.lit(cv)) & (i > F.lit(cursor_id))))
    return df.orderBy(*order).limit(limit)


def top_k(df: DataFrame, score_col: str, k: int, tie_cols: Sequence[str]) -> DataFrame:
    """Top k by score descending, ties broken by ``tie_cols`` ascending (stable)."""
    return df.orderBy(F.col(score_col).desc(), *[F.col(c) for c in tie_cols]).limit(k)


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], score_col: str, k: int,
                    tie_cols: Sequence[str], rank_col: str = "rank") -> DataFrame:
    """Top k per group.  A filtered ``row_number`` is planned with a per-partition
    group limit (WindowGroupLimit) so each mapper only forwards k rows per group."""
    w = Window.partitionBy(*group_cols).orderBy(F.col(score_col).desc(), *[F.col(c) for c in tie_cols])
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k) \
        .withColumn(rank_col, F.col(rank_col).cast("bigint"))


def running_sum(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str], value_col: str,
                out_col: str = "running", num_chunks: int | None = None) -> DataFrame:
    """Running sum per partition key in order, as a two-level prefix sum.

    Rows are range-partitioned on (partition key, order key), so a hot key
    spans several chunks.  Each chunk sums its rows; a window over the (few)
    chunk totals of a key gives each chunk's offset; the in-chunk running sum
    plus the offset is the answer.  Equal to a single window when order keys
    are unique within a partition key."""
    p = list(partition_cols)
    n = num_chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, *[F.col(c) for c in p + list(order_cols)]).withColumn("__pid", F.spark_partition_id())
    totals = r.groupBy(*p, "__pid").agg(F.sum(value_col).alias("__ct"))
    w_off = Window.partitionBy(*p).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__ct").over(w_off), F.lit(0))).drop("__ct")
    w_in = Window.partitionBy(*p, "__pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding,
                                                                           Window.currentRow)
    return (r.withColumn("__in", F.sum(value_col).over(w_in))
            .join(offsets, p + ["__pid"], "inner")
            .withColumn(out_col, F.col("__in") + F.col("__off"))
            .drop("__pid", "__in", "__off"))


def running_budget(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str], value_col: str,
                   budget: float, out_col: str = "running") -> DataFrame:
    """Keep rows while the running total stays within ``budget``.  With
    non-negative values this equals a loop that stops at the first overflow."""
    return running_sum(df, partition_cols, order_cols, value_col, out_col).filter(F.col(out_col) <= F.lit(budget))
