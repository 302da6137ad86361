"""Exact per-group "first m rows by a uniform hash" without one task per group.

A window ``row_number() over (partition by g order by h)`` puts every row of a
group into one task; with a hot group (a third of the data) that task is the
whole job.  Because the order key is an md5 hex string (uniform), a histogram
over its first ``d`` hex digits splits every group into balanced buckets:

1. counts per (group, bucket)              -- map-side combined aggregate
2. running count over the buckets of a group -- small table, one row per bucket
3. rows in buckets fully below the quota are kept outright; only the single
   boundary bucket of each group is ranked with a window partitioned by
   (group, bucket), whose size is about ``rows_per_bucket``.

The result is identical to the window formulation (order by hash, then tie key).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_BUCKET_ROWS = 200_000


def _digits_for(max_group_rows: int) -> int:
    if max_group_rows <= TARGET_BUCKET_ROWS:
        return 1
    return min(8, 1 + math.ceil(math.log(max_group_rows / TARGET_BUCKET_ROWS, 16)))


def select_first_by_hash(df: DataFrame, group_cols: Sequence[str], hash_col: str, tie_cols: Sequence[str],
                         quotas: DataFrame, quota_col: str = "__quota", max_group_rows: int | None = None) -> DataFrame:
    """Keep, per group, the ``quota`` rows with the smallest (hash, tie) values.

    ``quotas`` has ``group_cols`` + ``quota_col`` (one row per group) and is
    joined to the data; it has one row per group.  ``max_group_rows`` sizes the
    buckets; when None it is read from the quota table's ``__cnt`` column.
    """
    g = list(group_cols)
    if max_group_rows is None:
        max_group_rows = quotas.agg(F.max("__cnt")).first()[0] or 0
    d = _digits_for(int(max_group_rows))
    b = F.substring(F.col(hash_col), 1, d)
    data = df.withColumn("__b", b)
    hist = data.groupBy(*g, "__b").agg(F.count(F.lit(1)).alias("__bn"))
    w = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (hist.join(quotas.select(*g, quota_col), g, "inner")
            .withColumn("__cum", F.sum("__bn").over(w))
            .withColumn("__before", F.col("__cum") - F.col("__bn")))
    # buckets entirely inside the quota, and the one boundary bucket per group
    full = hist.filter(F.col("__cum") <= F.col(quota_col)).select(*g, "__b")
    edge = (hist.filter((F.col("__before") < F.col(quota_col)) & (F.col("__cum") > F.col(quota_col)))
            .select(*g, "__b", (F.col(quota_col) - F.col("__before")).alias("__need")))
    kept_full = data.join(full, g + ["__b"], "left_semi")
    rank_w = Window.partitionBy(*g, "__b").orderBy(F.col(hash_col), *[F.col(c) for c in tie_cols])
    kept_edge = (data.join(edge, g + ["__b"], "inner")
                 .withColumn("__rn", F.row_number().over(rank_w))
                 .filter(F.col("__rn") <= F.col("__need"))
                 .drop("__rn", "__need"))
    return kept_full.unionByName(kept_edge).drop("__b")


def seeded_hash(key_cols: Sequence[str], seed: int) -> Column:
    """md5 of the key text followed by the seed (same as DuckDB ``md5``)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]
    return F.md5(F.concat(*parts, F.lit(str(seed))))
