"""Aggregation operators (AGG-01..15).

All of them are hash aggregates with partial (map-side) aggregation, so a hot
group key is pre-reduced on every mapper before the shuffle.  Several reports
that the reference computes with one query per dimension are a single
``GROUPING SETS`` pass here.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.quantiles import quantile_expr

log = logging.getLogger(__name__)

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


# AGG-01 ---------------------------------------------------------------------
#: Aggregations of a profile: function and suffix of the output's name.
GROUP_FUNCTIONS = {"mean": (F.avg, "_mean"), "sum": (F.sum, "_sum"), "min": (F.min, "_min"), "max": (F.max, "_max"),
                   "count": (F.count, "_count"), "std": (F.stddev_samp, "_std")}
#: These keep the column's name and pick by the order column.
ORDERED_FUNCTIONS = {"first": F.min_by, "last": F.max_by}


def config_groupby(df: DataFrame, group_by: Sequence[str], aggregations: Mapping[str, str],
                   order_col: str | None = None) -> DataFrame:
    """``{column: function}`` by the keys that the table has, as ``<column>_<function>``.

    Without a known key, or without a known column and function, the table comes
    back as it is.  ``first``/``last`` need ``order_col``: rows have no order of their own."""
    wanted = {c: fn.lower() for c, fn in aggregations.items() if c in df.columns}
    if order_col is None and set(wanted.values()) & set(ORDERED_FUNCTIONS):
        raise ValueError("first/last need an order column")
    for c, fn in wanted.items():
        if fn not in GROUP_FUNCTIONS and fn not in ORDERED_FUNCTIONS:
            log.warning("aggregation %s of %s is unknown: left out", fn, c)
    picked = [ORDERED_FUNCTIONS[fn](c, order_col).alias(c) for c, fn in wanted.items() if fn in ORDERED_FUNCTIONS]
    computed = [GROUP_FUNCTIONS[fn][0](c).alias(c + GROUP_FUNCTIONS[fn][1]) for c, fn in wanted.items() if fn in GROUP_FUNCTIONS]
    keys = [k for k in group_by if k in df.columns]
    return df.groupBy(*keys).agg(*computed, *picked) if keys and (computed or picked) else df


# AGG-02 ---------------------------------------------------------------------
def rollup_levels(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Every numeric non-level column -> ``_mean, _std, _count`` by levels."""
    exprs = []
    for c in numeric_columns(df, exclude=levels):
        exprs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.count(c).alias(f"{c}_count")]
    return df.groupBy(*levels).agg(*exprs) if exprs else df


# AGG-03 ---------------------------------------------------------------------
def table_stats(df: DataFrame) -> DataFrame:
    """Long form: one row per column with null count and numeric summary
    (std 0.0 when the table has one row).  One aggregate pass, then ``stack``."""
    nums = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"n{i}"))
        if c in nums:
            x = F.col(c).cast("double")
            aggs += [F.min(x).alias(f"mi{i}"), F.max(x).alias(f"ma{i}"), F.avg(x).alias(f"av{i}"),
                     F.stddev_samp(x).alias(f"sd{i}")]
        else:
            aggs += [F.lit(None).cast("double").alias(f"{p}{i}") for p in ("mi", "ma", "av", "sd")]
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{c}', {i}, n{i}, mi{i}, ma{i}, av{i}, sd{i}" for i, c in enumerate(df.columns))
    long = wide.selectExpr(
        "__rows",
        f"stack({len(df.columns)}, {parts}) AS (column_name, position, null_count, min, max, mean, std)")
    return long.select(
        F.col("column_name"), F.col("position").cast("int").alias("position"),
        F.col("__rows").alias("row_count"), F.lit(len(df.columns)).alias("column_count"),
        F.col("null_count"), "min", "max", "mean",
        F.when(F.col("mean").isNull(), None).when(F.col("__rows") == 1, F.lit(0.0)).otherwise(F.col("std")).alias("std"))


# AGG-04 ---------------------------------------------------------------------
def column_stats(df: DataFrame, column: str, samples: int = 5, order_col: str | None = None) -> DataFrame:
    """non-null, null, unique (non-null), first ``samples`` values (by order), min/max/mean/std.

    The samples come from a bounded top-n (``orderBy().limit()``), joined to
    the one-row statistics on a constant key (both sides are one row)."""
    c = F.col(column)
    order = F.col(order_col) if order_col else c
    aggs = [F.count(c).alias("non_null"), F.count_if(c.isNull()).alias("nulls"), F.count_distinct(c).alias("unique")]
    if column in numeric_columns(df):
        x = c.cast("double")
        aggs += [F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")]
    else:
        aggs += [F.lit(None).cast("double").alias(n) for n in ("min", "max", "mean", "std")]
    stats = df.agg(*aggs).withColumn("column_name", F.lit(column)).withColumn("__k", F.lit(1))
    sample = (df.filter(c.isNotNull()).select(order.alias("o"), c.cast("string").alias("v"))
              .orderBy("o", "v").limit(samples)
              .agg(F.array_join(F.sort_array(F.collect_list(F.struct("o", "v"))).getField("v"), "|").alias("samples"))
              .withColumn("__k", F.lit(1)))
    return stats.join(sample, "__k").drop("__k")


# AGG-05 ---------------------------------------------------------------------
HEALTH = {0: "healthy", 1: "warning", 2: "critical"}


def column_health(stats: DataFrame, ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """From ``table_stats`` rows: null % > 50 critical, > 20 or out-of-range warning.
    Adds ``table_status`` = worst column status (a one-row aggregate joined back)."""
    pct = F.when(F.col("row_count") > 0, F.col("null_count") * 100.0 / F.col("row_count")).otherwise(F.lit(0.0))
    oor = F.lit(False)
    for name, (lo, hi) in (ranges or {}).items():
        oor = oor | ((F.col("column_name") == name) & ((F.col("min") < lo) | (F.col("max") > hi)))
    level = F.when(pct > 50, 2).when((pct > 20) | oor, 1).otherwise(0)
    hmap = F.create_map(*[x for k, v in HEALTH.items() for x in (F.lit(k), F.lit(v))])
    out = stats.select("column_name", F.round(pct, 6).alias("null_pct"), level.alias("__lvl"))
    # the table status is the worst column status: a one-row aggregate on a constant key
    worst = out.agg(F.max("__lvl").alias("__worst")).withColumn("__k", F.lit(1))
    return (out.withColumn("__k", F.lit(1)).join(worst, "__k")
            .select("column_name", "null_pct", F.element_at(hmap, F.col("__lvl")).alias("status"),
                    F.element_at(hmap, F.col("__worst")).alias("table_status")))


# AGG-06 / 07 / 08 -------------------------------------------------------------
#: Named groupings.
GROUPINGS = {"none": (), "by_side": ("side",), "by_wafer": ("wafer",), "by_side_wafer": ("side", "wafer"), "contexts": ("side", "wafer", "imcol")}
METRIC_FUNCTIONS = {"avg": F.avg, "median": F.median, **{name: fn for name, (fn, _) in GROUP_FUNCTIONS.items()}}


def parse_grouping(grouping: str | Sequence[str]) -> list[str]:
    """Columns of a grouping: a list as it is, a named one, or the rest of ``by_<column>``."""
    if isinstance(grouping, str):
        by_column = (grouping.removeprefix("by_"),) if grouping.startswith("by_") else ()
        return list(GROUPINGS.get(grouping, by_column))
    return [*grouping]


def group_pattern(df: DataFrame, grouping: str | Sequence[str], metrics: Sequence[str], agg: str = "mean") -> DataFrame:
    """Metrics by a grouping under their own names; rows with a null key are left out.
    The table comes back as it is when it has none of the keys or of the metrics."""
    present = set(df.columns)
    keys = [k for k in parse_grouping(grouping) if k in present]
    values = {m: METRIC_FUNCTIONS.get(agg, F.avg)(m) for m in metrics if m in present}
    if not (keys and values):
        return df
    return df.dropna(subset=keys).groupBy(*keys).agg(*(v.alias(m) for m, v in values.items()))


def report_table(df: DataFrame, filters: Mapping[str, object], grouping: str | Sequence[str],
                 metrics: Sequence[str] | None = None) -> DataFrame:
    """Filter (case-insensitive) -> metric columns (case-insensitive names; default all numeric) -> group mean."""
    from quarry.operators.filters import case_insensitive_filter

    lower = {c.lower(): c for c in df.columns}
    keys = [c for c in parse_grouping(grouping) if c in df.columns]
    mets = [lower[m.lower()] for m in metrics if m.lower() in lower] if metrics else numeric_columns(df, exclude=keys)
    return group_pattern(case_insensitive_filter(df, filters), keys, mets, "mean")


def kpi(df: DataFrame, metric: str, agg: str = "mean", decimals: int = 2) -> DataFrame:
    """One-row KPI: value and its ``.{decimals}f`` text (unknown agg -> mean)."""
    lower = {c.lower(): c for c in df.columns}
    if metric.lower() not in lower:
        raise ValueError(f"metric {metric} not found")
    col = lower[metric.lower()]
    val = METRIC_FUNCTIONS.get(agg, F.avg)(F.col(col)).cast("double")
    return df.agg(val.alias("value")).select(
        "value", F.regexp_replace(F.format_number(F.col("value"), decimals), ",", "").alias("text"))


# AGG-09 ---------------------------------------------------------------------
def pivot_mean(df: DataFrame, row: str, col: str, value: str, col_values: Sequence | None = None,
               long: bool = False) -> DataFrame:
    """Mean matrix rows x columns.  ``long=True`` returns (row, col, mean) which
    is the scale-safe form when the column domain is large."""
    if long:
        return df.groupBy(row, col).agg(F.avg(value).alias("mean"))
    if col_values is None:
        # the values are the output's columns; for a large domain ask for the long form
        col_values = [r[0] for r in df.select(col).distinct().orderBy(col).collect()]
    return df.groupBy(row).pivot(col, list(col_values)).agg(F.avg(value))


# AGG-10 ---------------------------------------------------------------------
def histogram(df: DataFrame, column: str, bins: int = 20, group_cols: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed; nulls dropped.
    Output: bin, lower, upper, count (per group when ``group_cols``)."""
    g = list(group_cols)
    x = F.col(column).cast("double")
    base = df.select(*[F.col(c) for c in group_cols], x.alias("__x")).filter(F.col("__x").isNotNull())
    ends = F.min("__x").alias("__lo"), F.max("__x").alias("__hi")
    if group_cols:
        rng = base.groupBy(*g).agg(*ends)
        ranged = base.join(rng, g, "inner")
    else:  # one row of statistics: literals, no join
        row = base.agg(*ends).first()
        ranged = base.withColumns({"__lo": F.lit(row["__lo"]).cast("double"), "__hi": F.lit(row["__hi"]).cast("double")})
    w = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    b = F.when(w == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("__x") - F.col("__lo")) / w), F.lit(bins - 1))).cast("int")
    # pre-aggregate to (group, bin) before the join: the range table has one row per group
    counted = (ranged.withColumn("bin", b)
               .groupBy(*g, "bin", "__lo", "__hi").agg(F.count(F.lit(1)).alias("count")))
    out = counted.select(*g, "bin",
                         (F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / bins).alias("lower"),
                         (F.col("__lo") + (F.col("bin") + 1) * (F.col("__hi") - F.col("__lo")) / bins).alias("upper"),
                         "count")
    return out


# AGG-11 ---------------------------------------------------------------------
def box_stats(df: DataFrame, value: str, by: Sequence[str] = (), whisker: float = 1.5,
              method: str = "exact") -> DataFrame:
    """Five-number summary per group + whiskers at the furthest data inside
    1.5*IQR (matplotlib) + outlier count.  Two aggregates joined on the group key."""
    g = list(by) or ["__g"]
    x = F.col(value).cast("double")
    base = df.select(*[F.col(c) for c in by], x.alias("__x")).filter(F.col("__x").isNotNull())
    if not by:
        base = base.withColumn("__g", F.lit(1))
    if method == "exact":
        # bounded-memory exact quantiles per group (histogram refinement)
        from quarry.functions.exact_quantile import group_quantiles

        q = group_quantiles(base, g, "__x", [0.25, 0.5, 0.75], ["q1", "median", "q3"], with_stats=True)
    else:
        q = base.groupBy(*g).agg(quantile_expr("__x", [0.25, 0.5, 0.75], method).alias("__q"),
                                 F.min("__x").alias("min"), F.max("__x").alias("max"),
                                 F.count(F.lit(1)).alias("n"))
        q = q.select(*g, "min", "max", "n", F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"),
                     F.col("__q")[2].alias("q3"))
    q = q.withColumn("__lo", F.col("q1") - whisker * (F.col("q3") - F.col("q1"))) \
         .withColumn("__hi", F.col("q3") + whisker * (F.col("q3") - F.col("q1")))
    from quarry.operators.joins import measured_broadcast
    from quarry.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    q = measured_broadcast(q.checkpoint(eager=True))  # a row a group
    inside = F.col("__x").between(F.col("__lo"), F.col("__hi"))
    w = (base.join(q.select(*g, "__lo", "__hi"), g, "inner").groupBy(*g)
         .agg(F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
              F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
              F.count_if(~inside).alias("outliers")))
    out = q.join(w, g, "inner").drop("__lo", "__hi")
    return out if by else out.drop("__g")


# AGG-12 ---------------------------------------------------------------------
def grouping_stats(df: DataFrame, dims: Sequence[str], size_col: str | None = None) -> DataFrame:
    """Counts (and bytes) by each dimension and in total in one grouping-sets pass.
    Output: dimension, value, count, bytes."""
    size = F.sum(size_col) if size_col else F.lit(None).cast("double")
    sets = df.groupingSets([*([d] for d in dims), []], *dims).agg(
        F.count(F.lit(1)).alias("count"), size.alias("bytes"), F.array(*[F.grouping(d) for d in dims]).alias("__g"))
    names, values = F.array(*map(F.lit, dims)), F.array(*[F.col(d).cast("string") for d in dims])
    at = F.array_position("__g", F.lit(0).cast("tinyint"))  # the dimension that is grouped by; 0 for the total
    return sets.select(F.when(at > 0, F.get(names, (at - 1).cast("int"))).otherwise("total").alias("dimension"),
                       F.when(at > 0, F.get(values, (at - 1).cast("int"))).alias("value"), "count", "bytes")


# AGG-13 ---------------------------------------------------------------------
def usage_cost(calls: DataFrame, prices: DataFrame, model_col: str = "model", in_col: str = "input_tokens",
               out_col: str = "output_tokens") -> DataFrame:
    """Per call cost ``in/1e6*price_in + out/1e6*price_out`` from a price table with a row per model.
    The join is left to Spark, which broadcasts the price table where its measured size allows."""
    return (calls.join(prices, model_col, "left")
            .withColumn("cost", F.coalesce(F.col(in_col), F.lit(0)) / 1e6 * F.coalesce(F.col("price_in"), F.lit(0.0))
                        + F.coalesce(F.col(out_col), F.lit(0)) / 1e6 * F.coalesce(F.col("price_out"), F.lit(0.0))))


def usage_totals(costed: DataFrame, in_col: str = "input_tokens", out_col: str = "output_tokens",
                 by: Sequence[str] = ()) -> DataFrame:
    return costed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.coalesce(F.col("cost"), F.lit(0.0))).alias("total_cost"),
        F.sum(F.coalesce(F.col(in_col), F.lit(0))).alias("total_input_tokens"),
        F.sum(F.coalesce(F.col(out_col), F.lit(0))).alias("total_output_tokens"))


# AGG-14 ---------------------------------------------------------------------
def pattern_ratio(df: DataFrame, columns: Sequence[str], patterns: Mapping[str, str], threshold: float = 0.5) -> DataFrame:
    """Share of non-null values matching each pattern, per (column, pattern);
    ``accepted`` when the share is above ``threshold``.  One aggregate."""
    aggs, names = [], []
    for i, c in enumerate(columns):
        for j, (pname, pat) in enumerate(patterns.items()):
            s = F.col(c).cast("string")
            aggs.append(F.avg(F.when(s.isNotNull(), s.rlike(pat).cast("int"))).alias(f"r_{i}_{j}"))
            names.append((c, pname, f"r_{i}_{j}"))
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{c}', '{p}', `{a}`" for c, p, a in names)
    return wide.selectExpr(f"stack({len(names)}, {parts}) AS (column_name, pattern, ratio)") \
        .withColumn("accepted", F.col("ratio") > threshold)


# AGG-15 ---------------------------------------------------------------------
def missing_keys(required: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """The required keys that are not mapped, one a row."""
    return required.select(key).distinct().join(mapped.select(key), key, "left_anti")


def coverage(required: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """Required and mapped distinct keys, mapped / required x 100, and its colour
    (green >= 100, yellow >= 80, else red; nothing required is green).
    :func:`missing_keys` has the keys behind the difference."""
    found = mapped.select(key).distinct().withColumn("__mapped", F.lit(True))
    counts = required.select(key).distinct().join(found, key, "left").agg(
        F.count(F.lit(1)).alias("required"), F.count("__mapped").alias("mapped"))
    pct = F.when(F.col("required") == 0, F.lit(100.0)).otherwise(F.col("mapped") * 100.0 / F.col("required"))
    colour = F.when(F.col("coverage_pct") >= 100, "green").when(F.col("coverage_pct") >= 80, "yellow").otherwise("red")
    return counts.withColumn("coverage_pct", F.round(pct, 6)).withColumn("status", colour)


# OPT-05 ---------------------------------------------------------------------------
def metric_aggregations(df: DataFrame, by: Sequence[str], metrics: Mapping[str, Sequence[str]],
                        method: str = "exact") -> DataFrame:
    """``{column: [mean, median, std, 3sigma, min, max, count]}`` per group.
    Medians with ``method='exact'`` use the bounded per-group refinement and are
    joined back on the group key."""
    exprs, medians = [], []
    for c, fns in metrics.items():
        x = F.col(c).cast("double")
        for fn in fns:
            if fn == "median" and method == "exact":
                medians.append(c)
            elif fn == "median":
                exprs.append(quantile_expr(x, [0.5], method)[0].alias(f"{c}_median"))
            elif fn == "3sigma":
                exprs.append((F.lit(3.0) * F.stddev_samp(x)).alias(f"{c}_3sigma"))
            elif fn == "mean":
                exprs.append(F.avg(x).alias(f"{c}_mean"))
            elif fn == "std":
                exprs.append(F.stddev_samp(x).alias(f"{c}_std"))
            elif fn in ("min", "max", "count"):
                exprs.append(getattr(F, fn)(x).alias(f"{c}_{fn}"))
    out = df.groupBy(*by).agg(*exprs) if exprs else df.select(*by).distinct()
    if medians:
        from quarry.functions.exact_quantile import group_quantiles

        for c in medians:
            out = out.join(group_quantiles(df, list(by), c, [0.5], [f"{c}_median"]), list(by), "left") if by \
                else out.withColumn("__k", F.lit(1)).join(
                    group_quantiles(df, [], c, [0.5], [f"{c}_median"]).withColumn("__k", F.lit(1)), "__k").drop("__k")
    return out
