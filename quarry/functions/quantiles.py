"""Quantiles for outlier rules and box statistics.

``method='exact'`` uses Spark's ``percentile`` (linear interpolation, the
same definition as DuckDB ``quantile_cont``).  Its partial aggregate keeps a
value -> count map, so memory grows with the number of *distinct* values of a
group; that is fine for measured/rounded data but not for a continuous column
of billions of distinct doubles.  ``method='approx'`` uses
``approx_percentile`` (a bounded sketch, rank error <= 1/accuracy) and is the
choice for such columns at cluster scale.  For global quantiles
``quantiles(method='nearest')`` picks the existing value at rank
``round(p*(n-1))`` (Polars' default interpolation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPROX_ACCURACY = 100_000


def quantile_expr(c: Column | str, probs: Sequence[float], method: str = "exact") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    arr = F.array(*[F.lit(float(p)) for p in probs])
    x = c.cast("double")
    if method == "exact":
        return F.percentile(x, arr)
    if method == "approx":
        return F.percentile_approx(x, arr, APPROX_ACCURACY)
    raise ValueError(f"unknown quantile method {method} for an aggregate expression")


def quantiles(df: DataFrame, column: str, probs: Sequence[float], method: str = "exact") -> list[float | None]:
    """Global quantiles of one column as Python floats.

    ``exact`` (default) locates the needed ranks by histogram refinement with
    bounded memory (see ``exact_quantile``); ``percentile`` is Spark's single
    aggregate (same values, memory grows with distinct values); ``approx`` and
    ``nearest`` as in ``quantile_expr``."""
    if method in ("exact", "nearest"):
        from quarry.functions.exact_quantile import exact_quantiles

        return exact_quantiles(df, column, probs, "linear" if method == "exact" else "nearest")
    if method == "percentile":
        method = "exact"
    src = df.select(F.col(column).alias("__qx")).filter(F.col("__qx").isNotNull())
    row = src.agg(quantile_expr("__qx", probs, method).alias("q")).first()
    vals = row["q"] if row is not None else None
    if vals is None:
        return [None] * len(probs)
    return [float(v) if v is not None else None for v in vals]
