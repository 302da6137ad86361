"""Source-of-variation statistics (STA-01..08).

The data is read once: one aggregate by all factors together gives count, mean
and variance of every response for each finest cell, without copying a row.  The
levels of each factor, each pair of factors and the total are combined from the
cells (deviations from the grand mean, so nothing large cancels).  Everything
after that is arithmetic on tables with one row per level/cell, still
expressed as Spark DataFrame operations; p-values come from a JVM expression
for the F tail (``functions.fdist_expr``).  Group values are never
materialised as arrays.

Sums of squares follow the marginal formulas: SS_A = sum n_a (m_a - M)^2,
SS_AB = max(0, SS_cells - SS_A - SS_B), residual = max(0, SS_T - explained).
These equal Type III sums only for balanced designs (documented limit).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.fdist_expr import f_sf_expr
from quarry.session import ensure_checkpoint_dir

RESULT_COLUMNS = ["response_column", "effect_order", "source", "ss", "df", "ms", "f", "p_value",
                  "variance_pct", "significant"]


def _effect_sets(factors: Sequence[str], interactions: bool) -> list[list[str]]:
    sets = [[f] for f in factors]
    if interactions:
        sets += [[a, b] for i, a in enumerate(factors) for b in factors[i + 1:]]
    return sets


def anova_cells(df: DataFrame, factors: Sequence[str], responses: Sequence[str],
                interactions: bool = True) -> DataFrame:
    """(response_column, effect parts, level keys) -> n, mean, var_pop, from one pass over the data.

    ``parts`` is the array of factor names of the effect ([] = total)."""
    factors = list(factors)
    vals = [r for r in responses if r in df.columns]
    if not vals:
        raise ValueError("no response column present")
    y = [F.col(r).cast("double") for r in vals]
    finest = df.groupBy(*factors).agg(*[e for i, c in enumerate(y) for e in (
        F.count(c).alias(f"__n{i}"), F.avg(c).alias(f"__m{i}"), F.var_pop(c).alias(f"__v{i}"))])
    ensure_checkpoint_dir(df.sparkSession)
    finest = finest.checkpoint(eager=True)  # one row a cell
    grand = finest.agg(*[(F.sum(F.col(f"__n{i}") * F.col(f"__m{i}")) / F.sum(f"__n{i}")).alias(r) for i, r in enumerate(vals)]).first()
    cell = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"__n{i}").alias("n"), (F.col(f"__n{i}") * F.col(f"__v{i}")).alias("m2"),
                                        (F.col(f"__m{i}") - F.lit(grand[r])).alias("d")) for i, r in enumerate(vals)]))
    cells = finest.select(*factors, cell.alias("__c")).select(*factors, F.col("__c.r").alias("response_column"), "__c.n", "__c.m2", "__c.d").where("n > 0")
    centre = F.create_map(*[x for r in vals for x in (F.lit(r), F.lit(grand[r]).cast("double"))])

    def effect(parts: list[str]) -> DataFrame:
        g = cells.groupBy("response_column", *parts).agg(
            F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("d"),
            F.sum(F.col("m2") + F.col("n") * F.col("d") * F.col("d")).alias("q"))
        absent = [F.lit(None).cast(df.schema[f].dataType).alias(f) if f not in parts else F.col(f) for f in factors]
        variance = F.greatest(F.col("q") / F.col("n") - F.col("d") * F.col("d"), F.lit(0.0))
        return g.select("response_column", *absent, "n", (F.element_at(centre, F.col("response_column")) + F.col("d")).alias("mean"),
                        variance.alias("var_pop"), F.array(*map(F.lit, parts)).cast("array<string>").alias("parts"))

    return reduce(DataFrame.unionByName, [effect(s) for s in _effect_sets(factors, interactions) + [[]]])


def anova(df: DataFrame, factors: Sequence[str], response: str | Sequence[str], alpha: float = 0.05,
          interactions: bool = True) -> DataFrame:
    """ANOVA table per response: one row per factor, per factor pair (when
    ``interactions`` and >= 2 factors), Residual and Total.

    Columns: response_column, effect_order, source, ss, df, ms, f, p_value,
    variance_pct, significant.  One-way: residual = sum n*var_pop (within);
    n-way: residual = max(0, SS_T - explained), df = N - df_explained - 1."""
    responses = [response] if isinstance(response, str) else list(response)
    factors = list(factors)
    cells = anova_cells(df, factors, responses, interactions and len(factors) >= 2)
    # The cell table (one row per level / cell) feeds several joins below.  It is
    # checkpointed to the shared checkpoint folder so the data is read exactly once
    # and later stages work on the small table only.
    ensure_checkpoint_dir(df.sparkSession)
    cells = cells.checkpoint(eager=True)
    tot = (cells.filter(F.size("parts") == 0)
           .select("response_column", F.col("n").alias("grand_n"), F.col("mean").alias("grand_mean"),
                   (F.col("n") * F.col("var_pop")).alias("ss_total")))
    # tot / mains / resid have one row per response (x factor): sizes fixed by the
    # configuration, not the data, so they are broadcast
    eff = (cells.filter(F.size("parts") > 0).join(F.broadcast(tot), "response_column")
           .groupBy("response_column", "parts")
           .agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand_mean"), 2)).alias("raw_ss"),
                F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("var_pop")).alias("within")))
    mains = eff.filter(F.size("parts") == 1).select("response_column", F.col("parts")[0].alias("fa"),
                                                     F.col("raw_ss").alias("ss"), "k", "within")
    order = {f: i for i, f in enumerate(factors)}
    pair_order = {f"{a}:{b}": len(factors) + j
                  for j, (a, b) in enumerate((a, b) for i, a in enumerate(factors) for b in factors[i + 1:])}
    omap = F.create_map(*[x for k, v in {**order, **pair_order}.items() for x in (F.lit(k), F.lit(v))])
    main_rows = mains.select("response_column", F.col("fa").alias("source"), "ss",
                             (F.col("k") - 1).cast("bigint").alias("df"), "within", "k")
    rows = main_rows
    if interactions and len(factors) >= 2:
        ma = mains.select("response_column", F.col("fa").alias("__a"), F.col("ss").alias("ss_a"), F.col("k").alias("k_a"))
        mb = mains.select("response_column", F.col("fa").alias("__b"), F.col("ss").alias("ss_b"), F.col("k").alias("k_b"))
        inter = (eff.filter(F.size("parts") == 2)
                 .select("response_column", F.col("parts")[0].alias("__a"), F.col("parts")[1].alias("__b"), "raw_ss")
                 .join(F.broadcast(ma), ["response_column", "__a"]).join(F.broadcast(mb), ["response_column", "__b"])
                 .select("response_column", F.concat_ws(":", "__a", "__b").alias("source"),
                         F.greatest(F.lit(0.0), F.col("raw_ss") - F.col("ss_a") - F.col("ss_b")).alias("ss"),
                         ((F.col("k_a") - 1) * (F.col("k_b") - 1)).cast("bigint").alias("df"),
                         F.lit(None).cast("double").alias("within"), F.lit(None).cast("bigint").alias("k")))
        rows = rows.unionByName(inter)
    one_way = len(factors) == 1
    expl = rows.groupBy("response_column").agg(F.sum("ss").alias("ss_expl"), F.sum("df").alias("df_expl"),
                                               F.max("within").alias("within1"), F.max("k").alias("k1"))
    resid = expl.join(F.broadcast(tot), "response_column").select(
        "response_column", "grand_n", "ss_total",
        (F.col("within1") if one_way else F.greatest(F.lit(0.0), F.col("ss_total") - F.col("ss_expl"))).alias("ss_res"),
        ((F.col("grand_n") - F.col("k1")) if one_way else (F.col("grand_n") - F.col("df_expl") - 1)).cast("bigint").alias("df_res"))
    resid = resid.withColumn("ms_res", F.when(F.col("df_res") > 0, F.col("ss_res") / F.col("df_res")).otherwise(F.lit(0.0)))
    pct = lambda ss: F.when(F.col("ss_total") > 0, ss / F.col("ss_total") * 100).otherwise(F.lit(0.0))
    ms = F.when(F.col("df") > 0, F.col("ss") / F.col("df")).otherwise(F.lit(0.0))
    # p-values: F upper tail as a JVM expression (Lanczos + continued fraction), no Python worker
    eff_out = (rows.join(F.broadcast(resid), "response_column")
               .withColumn("ms", ms)
               .withColumn("f", F.when(F.col("ms_res") > 0, F.col("ms") / F.col("ms_res")))
               .withColumn("p_value", f_sf_expr(F.col("f"), F.col("df"), F.col("df_res")))
               .select("response_column", F.element_at(omap, F.col("source")).alias("effect_order"), "source",
                       "ss", "df", "ms", "f", "p_value", pct(F.col("ss")).alias("variance_pct"),
                       F.coalesce(F.col("p_value") < F.lit(alpha), F.lit(False)).alias("significant")))
    nf = len(factors) + len(pair_order)
    res_out = resid.select("response_column", F.lit(nf).alias("effect_order"), F.lit("Residual").alias("source"),
                           F.col("ss_res").alias("ss"), F.col("df_res").alias("df"), F.col("ms_res").alias("ms"),
                           F.lit(None).cast("double").alias("f"), F.lit(None).cast("double").alias("p_value"),
                           pct(F.col("ss_res")).alias("variance_pct"), F.lit(False).alias("significant"))
    tot_out = tot.select("response_column", F.lit(nf + 1).alias("effect_order"), F.lit("Total").alias("source"),
                         F.col("ss_total").alias("ss"), (F.col("grand_n") - 1).cast("bigint").alias("df"),
                         F.lit(None).cast("double").alias("ms"), F.lit(None).cast("double").alias("f"),
                         F.lit(None).cast("double").alias("p_value"), F.lit(100.0).alias("variance_pct"),
                         F.lit(False).alias("significant"))
    return eff_out.unionByName(res_out).unionByName(tot_out)


def variance_check(table: DataFrame, tolerance: float = 0.01, on_fail: str = "warn") -> DataFrame:
    """STA-05: per response, shares without Total must sum to 100 +/- tolerance points."""
    out = (table.filter(F.col("source") != "Total").groupBy("response_column")
           .agg(F.sum("variance_pct").alias("variance_sum"))
           .withColumn("ok", F.abs(F.col("variance_sum") - 100.0) <= F.lit(tolerance)))
    if on_fail == "raise":
        bad = out.filter(~F.col("ok")).limit(1).collect()
        if bad:
            raise ValueError(f"variance shares sum to {bad[0]['variance_sum']:.2f}% for {bad[0]['response_column']}")
    return out


def effect_sizes(table: DataFrame) -> DataFrame:
    """STA-06 / OPT-02: eta^2 = share/100, partial eta^2, omega^2, R^2 per response,
    variance component estimate = SS."""
    res = table.filter(F.col("source") == "Residual").select(
        "response_column", F.col("ss").alias("ss_res"), F.col("ms").alias("ms_res"))
    tot = table.filter(F.col("source") == "Total").select("response_column", F.col("ss").alias("ss_tot"))
    eff = table.filter(~F.col("source").isin("Residual", "Total"))
    r2 = eff.groupBy("response_column").agg(F.sum("ss").alias("ss_expl"))
    return (eff.join(res, "response_column").join(tot, "response_column").join(r2, "response_column")
            .select("response_column", "source", F.col("ss").alias("variance_estimate"),
                    (F.col("variance_pct") / 100.0).alias("eta_squared"),
                    F.when(F.col("ss") + F.col("ss_res") > 0, F.col("ss") / (F.col("ss") + F.col("ss_res")))
                    .alias("partial_eta_squared"),
                    F.when(F.col("ss_tot") + F.col("ms_res") > 0,
                           (F.col("ss") - F.col("df") * F.col("ms_res")) / (F.col("ss_tot") + F.col("ms_res")))
                    .alias("omega_squared"),
                    F.when(F.col("ss_tot") > 0, F.col("ss_expl") / F.col("ss_tot")).otherwise(F.lit(0.0))
                    .alias("r_squared")))


# STA-08 variance bars ----------------------------------------------------------
def variance_bars(table: DataFrame) -> DataFrame:
    """Bars of an ANOVA table: per response each source but the total, its share and label, largest first."""
    w = Window.partitionBy("response_column").orderBy(F.desc("variance_pct"), "effect_order")  # a row an effect
    return table.where("source <> 'Total'").select(
        "response_column", F.row_number().over(w).cast("bigint").alias("bar"), "source", "variance_pct",
        F.concat(F.format_number("variance_pct", 1), F.lit("%")).alias("label"))


# STA-08 chart data ------------------------------------------------------------
def main_effects(df: DataFrame, factors: Sequence[str], response: str) -> DataFrame:
    """Per factor level: n, mean, std, se = std/sqrt(n); plus the grand mean.  One grouping-sets pass."""
    y = F.col(response).cast("double")
    base = df.select(*factors, y.alias("__y")).filter(F.col("__y").isNotNull())
    g = base.groupingSets([[f] for f in factors] + [[]], *factors).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__y").alias("mean"), F.stddev_samp("__y").alias("std"),
        F.grouping_id().alias("__gid"))
    grand = g.filter(F.col("__gid") == (1 << len(factors)) - 1).select(F.col("mean").alias("grand_mean"))
    parts = []
    for i, f in enumerate(factors):
        gid = ((1 << len(factors)) - 1) ^ (1 << (len(factors) - 1 - i))
        parts.append(g.filter(F.col("__gid") == gid).select(
            F.lit(f).alias("factor"), F.col(f).cast("string").alias("level"), "n", "mean", "std",
            (F.col("std") / F.sqrt(F.col("n"))).alias("se")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # grand has exactly one row: joined on a constant key
    return out.withColumn("__k", F.lit(1)).join(grand.withColumn("__k", F.lit(1)), "__k").drop("__k")


def interaction_means(df: DataFrame, a: str, b: str, response: str) -> DataFrame:
    y = F.col(response).cast("double")
    return (df.select(a, b, y.alias("__y")).filter(F.col("__y").isNotNull()).groupBy(a, b)
            .agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("mean"),
                 (F.stddev_samp("__y") / F.sqrt(F.count(F.lit(1)))).alias("se")))


def residuals(df: DataFrame, factors: Sequence[str], response: str) -> DataFrame:
    """Residual = value - mean of its factor cell.

    The cell means are a small table as a rule; measured so, they are broadcast, and
    a cell that holds a third of the rows is then never gathered in one task."""
    from quarry.operators.joins import measured_broadcast

    y = F.col(response).cast("double")
    base = df.select(*factors, y.alias("__y")).filter(F.col("__y").isNotNull())
    ensure_checkpoint_dir(df.sparkSession)
    cell = measured_broadcast(base.groupBy(*factors).agg(F.avg("__y").alias("__m")).checkpoint(eager=True))
    return base.join(cell, list(factors), "inner").select(*factors, (F.col("__y") - F.col("__m")).alias("residual"))


def residual_histogram(df: DataFrame, factors: Sequence[str], response: str, bins: int = 30) -> DataFrame:
    from quarry.operators.aggregates import histogram

    return histogram(residuals(df, factors, response), "residual", bins)


def qq_points(df: DataFrame, factors: Sequence[str], response: str) -> DataFrame:
    """Normal QQ points of the residuals: theoretical = Phi^-1((rank - 0.5) / n).

    Ranks come from the distributed row-position helper (no single-task window)."""
    from quarry.functions.fdist_expr import norm_ppf_expr
    from quarry.operators.joins import row_position

    r = residuals(df, factors, response).select("residual")
    n = r.count()
    ranked = row_position(r.withColumn("__tie", F.monotonically_increasing_id()), ["residual", "__tie"], "rank")
    return ranked.select("rank", F.col("residual").alias("sample"),
                         norm_ppf_expr((F.col("rank") - 0.5) / F.lit(n)).alias("theoretical"))



# OPT-01 / 03 / 04 -----------------------------------------------------------------
Z_975 = 1.959963984540054  # normal quantile used for the 95% interval (normal approximation)


def group_means(df: DataFrame, factor: str, response: str, z: float = Z_975) -> DataFrame:
    """Per level: count, mean, std, se and a normal-approximation confidence interval."""
    y = F.col(response).cast("double")
    g = (df.select(factor, y.alias("__y")).filter(F.col("__y").isNotNull()).groupBy(factor)
         .agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("mean"), F.stddev_samp("__y").alias("std")))
    se = F.col("std") / F.sqrt(F.col("n"))
    return g.withColumn("se", se).withColumn("ci_low", F.col("mean") - z * se) \
        .withColumn("ci_high", F.col("mean") + z * se)


def detect_roles(df: DataFrame, max_levels: int = 100, min_numeric: int = 10) -> DataFrame:
    """Factor candidates: non-numeric columns with at most ``max_levels`` distinct values;
    responses: numeric columns with at least ``min_numeric`` non-null values.

    Each column is counted by its values in an aggregate of its own, which reads that
    column alone: one aggregate of them all would copy every row, whole, once a column."""
    from pyspark.sql import types as T

    def counted(c: str, numeric: bool) -> DataFrame:
        values = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        of = values.agg(F.count("v").alias("d"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("n"))
        role = (F.when(F.lit(numeric) & (F.col("n") >= min_numeric), "response")
                .when(F.lit(not numeric) & (F.col("d") <= max_levels), "factor").otherwise("other"))
        return of.select(F.lit(c).alias("column_name"), role.alias("role"), F.col("d").alias("distinct_count"), F.col("n").alias("non_null"))

    return reduce(DataFrame.unionByName, [counted(f.name, isinstance(f.dataType, T.NumericType)) for f in df.schema.fields])


def transform_response(df: DataFrame, response: str, transform: str | None = None, where: str | None = None,
                       out: str | None = None) -> DataFrame:
    """Optional filter expression, then log / sqrt / inverse of the response
    (undefined values -> null)."""
    if where:
        df = df.filter(F.expr(where))
    y = F.col(response).cast("double")
    if transform == "log":
        v = F.when(y > 0, F.ln(y))
    elif transform == "sqrt":
        v = F.when(y >= 0, F.sqrt(y))
    elif transform == "inverse":
        v = F.try_divide(F.lit(1.0), y)
    elif transform in (None, "none"):
        v = y
    else:
        raise ValueError(f"unknown transform {transform}")
    return df.withColumn(out or response, v)
