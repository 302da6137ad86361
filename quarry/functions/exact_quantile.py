"""Exact global quantiles with bounded memory (``method='refine'``).

Spark's ``percentile`` merges a value -> count map of the whole column in one
task, which is unbounded for a continuous column.  Here the ranks needed by
linear interpolation are located by histogram refinement:

1. one aggregate: n, min, max;
2. per pass: an equal-width histogram (``BUCKETS`` buckets, map-side combined)
   over the current value range of every unresolved rank; the bucket that holds
   the rank becomes the next range (bucket membership is re-expressed with the
   same ``floor`` formula, so the chained ranges are exact);
3. when a range holds at most ``FINAL_ROWS`` values (or a single distinct
   value), those values are sorted and the rank is read off.

Every pass returns at most ``ranks x BUCKETS`` rows to the driver; no task ever
holds more than ``FINAL_ROWS`` values.  Results equal ``percentile``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
FINAL_ROWS = 1_000_000


def _place(x: Column, lo: Column, hi: Column) -> Column:
    """Bucket of x in [lo, hi], lo < hi.  The quotient is formed so that neither a
    huge range overflows nor a tiny one loses its width."""
    wide = F.abs(hi) + F.abs(lo) > 1e300
    share = F.when(wide, (x / 4 - lo / 4) / (hi / 4 - lo / 4)).otherwise((x - lo) / (hi - lo))
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def _value_at_rank(x: DataFrame, rank: int) -> float:
    """Value with 0-based rank ``rank`` in ascending order of column ``x``.

    Passes go on until the range is single-valued or small enough to sort: the
    end values of a range fall into different buckets, so each pass narrows it."""
    cond, below = F.lit(True), 0
    row = x.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, hi, cnt = row["lo"], row["hi"], row["n"]
    while lo < hi and cnt > FINAL_ROWS:
        b = _place(F.col("x"), F.lit(lo), F.lit(hi))
        hist = (x.filter(cond).groupBy(b.alias("b"))
                .agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("mn"), F.max("x").alias("mx"))
                .orderBy("b").collect())
        for h in hist:
            if below + h["c"] > rank:
                cond = cond & (b == F.lit(h["b"]))
                lo, hi, cnt = h["mn"], h["mx"], h["c"]
                break
            below += h["c"]
    if lo == hi:
        return float(lo)
    return float(x.filter(cond).select("x").orderBy("x").offset(rank - below).limit(1).first()[0])


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float],
                    interpolation: str = "linear") -> list[float | None]:
    """Linear-interpolation quantiles (same definition as ``percentile``), or
    ``nearest``: the value at rank ``round(p*(n-1))`` (half away from zero)."""
    x = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    n = x.count()
    if n == 0:
        return [None] * len(probs)
    out = []
    cache: dict[int, float] = {}
    for p in probs:
        h = p * (n - 1)
        if interpolation == "nearest":
            k = int(math.floor(h + 0.5))
            if k not in cache:
                cache[k] = _value_at_rank(x, k)
            out.append(cache[k])
            continue
        k0, k1 = math.floor(h), math.ceil(h)
        for k in (k0, k1):
            if k not in cache:
                cache[k] = _value_at_rank(x, k)
        # same interpolation expression as Spark's percentile (bit-identical results)
        out.append(cache[k0] if k0 == k1 else (k1 - h) * cache[k0] + (h - k0) * cache[k1])
    return out


def group_quantiles(df: DataFrame, group_cols: Sequence[str], column: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, with_stats: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles per group with bounded memory.

    The refinement state is a small table with one row per (group, needed
    rank): value range [lo, hi] and the count of values below it.  Each pass
    joins the data with the open targets, builds a histogram per target (map-side
    combined), and a window over one target's <= BUCKETS histogram rows picks the
    bucket holding the rank.  Targets whose range holds <= FINAL_ROWS values are
    finished by a window over just those values; a single-valued range needs no
    sort at all.  Output: group columns + one column per probability."""
    from pyspark.sql import Window

    from quarry.operators.joins import measured_broadcast
    from quarry.session import ensure_checkpoint_dir

    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    g = list(group_cols) or ["__g"]
    base = df.select(*[F.col(c) for c in group_cols], F.col(column).cast("double").alias("__x")) \
        .filter(F.col("__x").isNotNull())
    if not group_cols:
        base = base.withColumn("__g", F.lit(1))
    ensure_checkpoint_dir(df.sparkSession)
    stats = base.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"),
                                 F.max("__x").alias("__hi"))
    ranks = []
    for p in probs:
        h = F.lit(float(p)) * (F.col("__n") - 1)
        ranks += [F.floor(h).cast("long"), F.ceil(h).cast("long")]
    state = (stats.select(*g, "__n", "__lo", "__hi", F.explode(F.array_distinct(F.array(*ranks))).alias("__r"))
             .select(*g, "__r", "__lo", "__hi", F.lit(0).cast("long").alias("__below"),
                     F.col("__n").alias("__cnt"), "__n", F.col("__lo").alias("__min"), F.col("__hi").alias("__max"))
             ).checkpoint(eager=True)
    # group size / min / max travel with the (checkpointed) state: no second scan
    gstats = state.groupBy(*g).agg(F.first("__n").alias("__n"), F.first("__min").alias("min"),
                                   F.first("__max").alias("max"))
    keys = g + ["__r"]
    while True:  # each pass narrows every open range
        is_open = (F.col("__cnt") > FINAL_ROWS) & (F.col("__lo") < F.col("__hi"))
        open_t = state.filter(is_open)
        if open_t.limit(1).count() == 0:
            break
        j = base.join(measured_broadcast(open_t.select(*keys, "__lo", "__hi", "__below")), g) \
            .filter(F.col("__x").between(F.col("__lo"), F.col("__hi")))
        b = _place(F.col("__x"), F.col("__lo"), F.col("__hi"))
        hist = j.groupBy(*keys, "__below", b.alias("__b")).agg(
            F.count(F.lit(1)).alias("__c"), F.min("__x").alias("__mn"), F.max("__x").alias("__mx"))
        cw = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        acc = F.col("__below") + F.sum("__c").over(cw) - F.col("__c")
        picked = (hist.withColumn("__acc", acc)
                  .filter((F.col("__acc") <= F.col("__r")) & (F.col("__r") < F.col("__acc") + F.col("__c")))
                  .select(*keys, F.col("__mn").alias("__lo"), F.col("__mx").alias("__hi"),
                          F.col("__acc").alias("__below"), F.col("__c").alias("__cnt")))
        state = state.filter(~is_open).select(*keys, "__lo", "__hi", "__below", "__cnt") \
            .unionByName(picked).checkpoint(eager=True)
    single = state.filter(F.col("__lo") == F.col("__hi")).select(*keys, F.col("__lo").alias("__v"))
    # targets sharing a final range (e.g. all ranks of an unrefined group) are
    # resolved by ONE sort of that range, picking every requested rank from it
    ranges = (state.filter(F.col("__lo") < F.col("__hi"))
              .groupBy(*g, "__lo", "__hi", "__below").agg(F.collect_set("__r").alias("__rs"))).checkpoint(eager=True)
    rkeys = g + ["__lo", "__hi", "__below"]
    j = base.join(measured_broadcast(ranges), g).filter(F.col("__x").between(F.col("__lo"), F.col("__hi")))
    ow = Window.partitionBy(*rkeys).orderBy("__x")  # one final range only
    found = (j.withColumn("__k", F.row_number().over(ow) - 1 + F.col("__below"))
             .filter(F.array_contains("__rs", F.col("__k")))
             .select(*g, F.col("__k").alias("__r"), F.col("__x").alias("__v")))
    vals = single.unionByName(found).groupBy(*g).agg(
        F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__m"))  # <= 2 entries per probability
    out = gstats.join(vals, g)
    cols = []
    for p, name in zip(probs, names):
        h = F.lit(float(p)) * (F.col("__n") - 1)
        k0, k1 = F.floor(h).cast("long"), F.ceil(h).cast("long")
        v0, v1 = F.element_at("__m", k0), F.element_at("__m", k1)
        cols.append(F.when(k0 == k1, v0).otherwise((k1 - h) * v0 + (h - k0) * v1).alias(name))
    extra = [F.col("__n").alias("n"), "min", "max"] if with_stats else []
    res = out.select(*g, *extra, *cols)
    return res if group_cols else res.drop("__g")
