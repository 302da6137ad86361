"""Registered queries for the ANOVA / source-of-variation operators (STA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import stats as ST
from quarry.plans.registry import query, rounded, table


def _anova_sql(tbl: str, factors: list[str], resp: str) -> str:
    """DuckDB statement with the same (marginal) ANOVA formulas, unrounded."""
    nf = len(factors)
    pairs = [(i, j) for i in range(nf) for j in range(i + 1, nf)] if nf >= 2 else []
    ctes = [f"d AS (SELECT {', '.join(factors)}, CAST({resp} AS DOUBLE) AS y FROM {tbl} WHERE {resp} IS NOT NULL)",
            "g AS (SELECT count(*) AS N, avg(y) AS M, var_pop(y) * count(*) AS SST FROM d)"]
    for i, f in enumerate(factors):
        ctes.append(f"c{i} AS (SELECT {f} AS lv, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM d GROUP BY 1)")
        ctes.append(f"e{i} AS (SELECT sum(c{i}.n * (c{i}.m - g.M) * (c{i}.m - g.M)) AS ss, count(*) AS k, "
                    f"sum(c{i}.n * c{i}.v) AS within FROM c{i}, g)")
    for i, j in pairs:
        ctes.append(f"p{i}{j} AS (SELECT sum(t.n * (t.m - g.M) * (t.m - g.M)) AS raw FROM "
                    f"(SELECT count(*) AS n, avg(y) AS m FROM d GROUP BY {factors[i]}, {factors[j]}) t, g)")
    eff = [f"SELECT {i} AS effect_order, '{f}' AS source, e{i}.ss AS ss, e{i}.k - 1 AS df FROM e{i}"
           for i, f in enumerate(factors)]
    for n, (i, j) in enumerate(pairs):
        eff.append(f"SELECT {nf + n} AS effect_order, '{factors[i]}:{factors[j]}' AS source, "
                   f"greatest(0, p{i}{j}.raw - e{i}.ss - e{j}.ss) AS ss, (e{i}.k - 1) * (e{j}.k - 1) AS df "
                   f"FROM p{i}{j}, e{i}, e{j}")
    ctes.append("eff AS (" + " UNION ALL ".join(eff) + ")")
    if nf == 1:
        ctes.append("res AS (SELECT e0.within AS ss_res, g.N - e0.k AS df_res FROM e0, g)")
    else:
        ctes.append("res AS (SELECT greatest(0, g.SST - x.sx) AS ss_res, g.N - x.dx - 1 AS df_res "
                    "FROM g, (SELECT sum(ss) AS sx, sum(df) AS dx FROM eff) x)")
    ctes.append("res2 AS (SELECT ss_res, df_res, CASE WHEN df_res > 0 THEN ss_res / df_res ELSE 0 END AS ms_res FROM res)")
    last = nf + len(pairs)
    body = f"""
SELECT '{resp}' AS response_column, effect_order, source, ss, CAST(df AS BIGINT) AS df, ms, f, variance_pct FROM (
  SELECT effect_order, source, ss, df, CASE WHEN df > 0 THEN ss / df ELSE 0 END AS ms,
         CASE WHEN res2.ms_res > 0 THEN (CASE WHEN df > 0 THEN ss / df ELSE 0 END) / res2.ms_res END AS f,
         CASE WHEN g.SST > 0 THEN ss / g.SST * 100 ELSE 0 END AS variance_pct FROM eff, res2, g
  UNION ALL SELECT {last}, 'Residual', ss_res, df_res, ms_res, NULL,
         CASE WHEN g.SST > 0 THEN ss_res / g.SST * 100 ELSE 0 END FROM res2, g
  UNION ALL SELECT {last + 1}, 'Total', SST, N - 1, NULL, NULL, 100.0 FROM g)"""
    return "SELECT * FROM (WITH " + ",\n".join(ctes) + body + ")"


# Sums of squares of prices reach 1e13; the two engines sum in different orders,
# so they are compared in units of 1e9 (ss_e9, ms_e9) rounded to 6 decimals.
def _anova_rounded_sql(inner: str) -> str:
    return (f"SELECT response_column, effect_order, source, round(ss / 1e9, 6) AS ss_e9, df, "
            f"round(ms / 1e9, 6) AS ms_e9, round(f, 6) AS f, round(variance_pct, 6) AS variance_pct FROM ({inner})")


def _round_table(df):
    return df.select("response_column", "effect_order", "source", F.round(F.col("ss") / 1e9, 6).alias("ss_e9"), "df",
                     F.round(F.col("ms") / 1e9, 6).alias("ms_e9"), F.round("f", 6).alias("f"),
                     F.round("variance_pct", 6).alias("variance_pct"))


_ONE = _anova_sql("lineitem", ["l_returnflag"], "l_quantity")
_TWO = _anova_sql("lineitem", ["l_returnflag", "l_linestatus"], "l_extendedprice")
_MULTI = " UNION ALL ".join(_anova_sql("lineitem", ["l_returnflag", "l_linestatus"], r)
                            for r in ("l_quantity", "l_discount"))


@query("anova_one_way", _anova_rounded_sql(_ONE))
def q_anova_one_way(spark, sf):
    t = ST.anova(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")
    return _round_table(t)


# with two numerator degrees of freedom the F tail has a closed form
@query("anova_p_value", f"""
SELECT source, round(f, 6) AS f, round(p, 9) AS p_value, coalesce(p < 0.05, false) AS significant FROM (
  SELECT source, f, CASE WHEN source = 'l_returnflag' THEN exp(-d2 / 2.0 * ln(1 + 2 * f / d2)) END AS p
  FROM ({_ONE}) t, (SELECT df AS d2 FROM ({_ONE}) WHERE source = 'Residual') r)
""")
def q_anova_p_value(spark, sf):
    t = ST.anova(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")
    return t.select("source", F.round("f", 6).alias("f"), F.round("p_value", 9).alias("p_value"), "significant")


@query("variance_bars", f"""
SELECT response_column, row_number() OVER (ORDER BY variance_pct DESC, effect_order) AS bar, source, round(variance_pct, 6) AS variance_pct,
       format('{{:.1f}}%', variance_pct) AS label FROM ({_TWO}) WHERE source <> 'Total'
""")
def q_variance_bars(spark, sf):
    return rounded(ST.variance_bars(ST.anova(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")))


@query("anova_two_way", _anova_rounded_sql(_TWO))
def q_anova_two_way(spark, sf):
    t = ST.anova(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return _round_table(t)


@query("anova_multi_response", _anova_rounded_sql(_MULTI))
def q_anova_multi_response(spark, sf):
    t = ST.anova(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
                 ["l_quantity", "l_discount", "not_a_column"])
    return _round_table(t)


@query("variance_check", f"""
SELECT response_column, round(sum(variance_pct), 6) AS variance_sum, abs(sum(variance_pct) - 100.0) <= 0.01 AS ok
FROM ({_MULTI}) WHERE source <> 'Total' GROUP BY 1
""")
def q_variance_check(spark, sf):
    t = ST.anova(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])
    return rounded(ST.variance_check(t))


@query("effect_sizes", f"""
WITH t AS ({_TWO}),
     r AS (SELECT ss AS ss_res, ms AS ms_res FROM t WHERE source = 'Residual'),
     tt AS (SELECT ss AS ss_tot FROM t WHERE source = 'Total'),
     x AS (SELECT sum(ss) AS ss_expl FROM t WHERE source NOT IN ('Residual', 'Total'))
SELECT response_column, source, round(ss / 1e9, 6) AS variance_estimate, round(variance_pct / 100.0, 6) AS eta_squared,
       round(CASE WHEN ss + ss_res > 0 THEN ss / (ss + ss_res) END, 6) AS partial_eta_squared,
       round(CASE WHEN ss_tot + ms_res > 0 THEN (ss - df * ms_res) / (ss_tot + ms_res) END, 6) AS omega_squared,
       round(CASE WHEN ss_tot > 0 THEN ss_expl / ss_tot ELSE 0 END, 6) AS r_squared
FROM t, r, tt, x WHERE source NOT IN ('Residual', 'Total')
""")
def q_effect_sizes(spark, sf):
    t = ST.anova(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    e = ST.effect_sizes(t)
    return rounded(e.withColumn("variance_estimate", F.round(F.col("variance_estimate") / 1e9, 6)))


@query("main_effects", """
WITH d AS (SELECT l_returnflag, l_linestatus, l_quantity AS y FROM lineitem)
SELECT 'l_returnflag' AS factor, l_returnflag AS level, count(*) AS n, round(avg(y), 6) AS mean,
       round(stddev_samp(y), 6) AS std, round(stddev_samp(y) / sqrt(count(*)), 6) AS se,
       (SELECT round(avg(y), 6) FROM d) AS grand_mean FROM d GROUP BY 2
UNION ALL
SELECT 'l_linestatus', l_linestatus, count(*), round(avg(y), 6), round(stddev_samp(y), 6),
       round(stddev_samp(y) / sqrt(count(*)), 6), (SELECT round(avg(y), 6) FROM d) FROM d GROUP BY 2
""")
def q_main_effects(spark, sf):
    return rounded(ST.main_effects(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"))


@query("interaction_means", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean,
       round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS se
FROM lineitem GROUP BY 1, 2
""")
def q_interaction_means(spark, sf):
    return rounded(ST.interaction_means(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity"))


@query("residual_histogram", """
WITH c AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2),
     r AS (SELECT l.l_quantity - c.m AS x FROM lineitem l JOIN c USING (l_returnflag, l_linestatus)),
     b AS (SELECT min(x) AS lo, max(x) AS hi FROM r),
     h AS (SELECT CASE WHEN (b.hi - b.lo) / 30 = 0 THEN 0
                       ELSE CAST(least(floor((r.x - b.lo) / ((b.hi - b.lo) / 30)), 29) AS INTEGER) END AS bin,
                  b.lo, b.hi FROM r, b)
SELECT bin, round(lo + bin * (hi - lo) / 30, 6) AS lower, round(lo + (bin + 1) * (hi - lo) / 30, 6) AS upper,
       count(*) AS count FROM h GROUP BY bin, lo, hi
""")
def q_residual_histogram(spark, sf):
    return rounded(ST.residual_histogram(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
                                         "l_quantity", 30))
