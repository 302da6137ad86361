"""Registered queries for aggregation (AGG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import aggregates as A
from quarry.plans.registry import query, rounded, table


@query("agg_config", """
SELECT l_returnflag, l_linestatus,
       sum(l_quantity) AS l_quantity_sum, round(avg(l_extendedprice), 6) AS l_extendedprice_mean,
       max(l_discount) AS l_discount_max, min(l_tax) AS l_tax_min, count(l_orderkey) AS l_orderkey_count,
       round(stddev_samp(l_partkey), 6) AS l_partkey_std
FROM lineitem GROUP BY 1, 2
""")
def q_agg_config(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(A.config_groupby(li, ["l_returnflag", "l_linestatus", "nope"], {
        "l_quantity": "sum", "l_extendedprice": "mean", "l_discount": "max", "l_tax": "min",
        "l_orderkey": "count", "l_partkey": "std", "missing": "sum"}))


@query("agg_first_last", """
SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_totalprice, o_orderkey) AS o_totalprice
FROM orders GROUP BY 1
""")
def q_agg_first_last(spark, sf):
    o = table(spark, sf, "orders")
    a = A.config_groupby(o, ["o_custkey"], {"o_orderstatus": "first"}, order_col="o_orderkey")
    b = A.config_groupby(o, ["o_custkey"], {"o_totalprice": "last"}, order_col="o_orderkey")
    return a.join(b, "o_custkey")


_LEVEL_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax"]


@query("agg_levels", "SELECT l_returnflag, l_linestatus, " + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, count({c}) AS {c}_count"
    for c in _LEVEL_COLS) + " FROM lineitem GROUP BY 1, 2")
def q_agg_levels(spark, sf):
    return rounded(A.rollup_levels(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]))


_PART_COLS = [("p_partkey", True), ("p_name", False), ("p_brand", False), ("p_type", False), ("p_size", True),
              ("p_retailprice", True)]


@query("table_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS position, count(*) AS row_count, 6 AS column_count, "
    f"count(*) - count({c}) AS null_count, "
    + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean, "
       f"round(stddev_samp({c}), 6) AS std" if num else
       "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std")
    + " FROM part" for i, (c, num) in enumerate(_PART_COLS)))
def q_table_stats(spark, sf):
    return rounded(A.table_stats(table(spark, sf, "part")))


@query("column_stats", """
SELECT count(c_acctbal) AS non_null, count(*) - count(c_acctbal) AS nulls, count(DISTINCT c_acctbal) AS "unique",
       min(c_acctbal) AS min, max(c_acctbal) AS max, round(avg(c_acctbal), 6) AS mean,
       round(stddev_samp(c_acctbal), 6) AS std, 'c_acctbal' AS column_name,
       (SELECT string_agg(CAST(c_acctbal AS VARCHAR), '|' ORDER BY c_custkey)
        FROM (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 5)) AS samples
FROM customer
""")
def q_column_stats(spark, sf):
    return rounded(A.column_stats(table(spark, sf, "customer"), "c_acctbal", 5, order_col="c_custkey"))


@query("column_health", """
WITH p AS (SELECT p_partkey, nullif(p_brand, 'Brand#1') AS p_brand,
                  CASE WHEN p_size <= 30 THEN NULL ELSE p_type END AS p_type, p_size FROM part),
     s AS (SELECT 'p_partkey' AS column_name, count(*) - count(p_partkey) AS nn, count(*) AS n, max(p_partkey) AS mx FROM p
           UNION ALL SELECT 'p_brand', count(*) - count(p_brand), count(*), NULL FROM p
           UNION ALL SELECT 'p_type', count(*) - count(p_type), count(*), NULL FROM p
           UNION ALL SELECT 'p_size', count(*) - count(p_size), count(*), max(p_size) FROM p),
     l AS (SELECT column_name, round(nn * 100.0 / n, 6) AS null_pct,
                  CASE WHEN nn * 100.0 / n > 50 THEN 2
                       WHEN nn * 100.0 / n > 20 OR (column_name = 'p_size' AND mx > 45) THEN 1 ELSE 0 END AS lvl FROM s)
SELECT column_name, null_pct,
       CASE lvl WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'healthy' END AS status,
       CASE (SELECT max(lvl) FROM l) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'healthy' END AS table_status
FROM l
""")
def q_column_health(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.nullif(F.col("p_brand"), F.lit("Brand#1")).alias("p_brand"),
        F.when(F.col("p_size") <= 30, None).otherwise(F.col("p_type")).alias("p_type"), "p_size")
    return A.column_health(A.table_stats(p), ranges={"p_size": (0, 45)})


@query("group_pattern", """
SELECT o_orderpriority, round(avg(o_totalprice), 6) AS o_totalprice FROM orders GROUP BY 1
""")
def q_group_pattern(spark, sf):
    return rounded(A.group_pattern(table(spark, sf, "orders"), "by_o_orderpriority", ["o_totalprice", "nope"]))


@query("report_table", """
SELECT l_linestatus, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount
FROM lineitem WHERE lower(l_returnflag) = 'r' GROUP BY 1
""")
def q_report_table(spark, sf):
    return rounded(A.report_table(table(spark, sf, "lineitem"), {"l_returnflag": "r", "l_linestatus": "both"},
                                  "by_l_linestatus", ["L_QUANTITY", "l_discount"]))


@query("kpi", """
SELECT round(avg(l_extendedprice), 6) AS value, printf('%.2f', avg(l_extendedprice)) AS text FROM lineitem
""")
def q_kpi(spark, sf):
    return rounded(A.kpi(table(spark, sf, "lineitem"), "L_EXTENDEDPRICE", "mean"))


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("pivot_mean", "SELECT o_orderstatus, " + ", ".join(
    f"round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '{p}'), 6) AS \"{p}\"" for p in _PRIOS)
    + " FROM orders GROUP BY 1")
def q_pivot_mean(spark, sf):
    return rounded(A.pivot_mean(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", _PRIOS))


@query("histogram", """
WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
     b AS (SELECT CASE WHEN (r.hi - r.lo) / 20 = 0 THEN 0
                       ELSE CAST(least(floor((e.value - r.lo) / ((r.hi - r.lo) / 20)), 19) AS INTEGER) END AS bin,
                  r.lo, r.hi FROM events e, r)
SELECT bin, round(lo + bin * (hi - lo) / 20, 6) AS lower, round(lo + (bin + 1) * (hi - lo) / 20, 6) AS upper,
       count(*) AS count
FROM b GROUP BY bin, lo, hi
""")
def q_histogram(spark, sf):
    return rounded(A.histogram(table(spark, sf, "events"), "value", 20))


@query("box_stats", """
WITH q AS (SELECT l_returnflag, min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(*) AS n,
                  quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
     w AS (SELECT l.l_returnflag,
                  min(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_low,
                  max(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_high,
                  count(*) FILTER (WHERE NOT (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
           FROM lineitem l JOIN q USING (l_returnflag) GROUP BY 1)
SELECT q.l_returnflag, min, max, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       whisker_low, whisker_high, outliers
FROM q JOIN w USING (l_returnflag)
""")
def q_box_stats(spark, sf):
    return rounded(A.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@query("grouping_stats", """
SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus'
            WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'total' END AS dimension,
       CASE WHEN grouping(o_orderstatus) = 0 THEN o_orderstatus
            WHEN grouping(o_orderpriority) = 0 THEN o_orderpriority END AS value,
       count(*) AS count, round(sum(o_totalprice), 2) AS bytes
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
""")
def q_grouping_stats(spark, sf):
    out = A.grouping_stats(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return out.withColumn("bytes", F.round("bytes", 2))


@query("usage_cost", """
WITH calls AS (SELECT role AS model, length(text) // 4 AS input_tokens, length(text) // 8 AS output_tokens
               FROM conversations),
     prices AS (SELECT * FROM (VALUES ('user', 3.0, 15.0), ('assistant', 0.25, 1.25)) p(model, price_in, price_out))
SELECT c.model, count(*) AS calls,
       round(sum(coalesce(c.input_tokens, 0) / 1e6 * coalesce(p.price_in, 0.0)
                 + coalesce(c.output_tokens, 0) / 1e6 * coalesce(p.price_out, 0.0)), 6) AS total_cost,
       CAST(sum(coalesce(c.input_tokens, 0)) AS BIGINT) AS total_input_tokens,
       CAST(sum(coalesce(c.output_tokens, 0)) AS BIGINT) AS total_output_tokens
FROM calls c LEFT JOIN prices p USING (model) GROUP BY c.model
""")
def q_usage_cost(spark, sf):
    conv = table(spark, sf, "conversations")
    calls = conv.select(F.col("role").alias("model"),
                        F.floor(F.length("text") / 4).cast("bigint").alias("input_tokens"),
                        F.floor(F.length("text") / 8).cast("bigint").alias("output_tokens"))
    prices = spark.createDataFrame([("user", 3.0, 15.0), ("assistant", 0.25, 1.25)],
                                   "model string, price_in double, price_out double")
    return rounded(A.usage_totals(A.usage_cost(calls, prices), by=["model"]))


_PATTERNS = {"brand": r"^Brand#[0-9]+$", "upper": r"^[A-Z ]+$", "two_words": r"^[a-z]+ [a-z]+$"}


@query("pattern_ratio", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{p}' AS pattern, "
    f"round(avg(CASE WHEN regexp_full_match({c}, '{rx}') THEN 1 ELSE 0 END), 6) AS ratio, "
    f"avg(CASE WHEN regexp_full_match({c}, '{rx}') THEN 1 ELSE 0 END) > 0.5 AS accepted FROM part"
    for c in ("p_name", "p_brand", "p_type") for p, rx in _PATTERNS.items()))
def q_pattern_ratio(spark, sf):
    return rounded(A.pattern_ratio(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], _PATTERNS))


_COVERAGE = """
WITH r AS (SELECT DISTINCT n_nationkey AS k FROM nation),
     m AS (SELECT DISTINCT c_nationkey * 3 AS k FROM customer)
"""


@query("coverage", _COVERAGE + """
, j AS (SELECT r.k, m.k AS mk FROM r LEFT JOIN m ON r.k = m.k)
SELECT count(*) AS required, count(mk) AS mapped, round(count(mk) * 100.0 / count(*), 6) AS coverage_pct,
       CASE WHEN count(mk) * 100.0 / count(*) >= 100 THEN 'green'
            WHEN count(mk) * 100.0 / count(*) >= 80 THEN 'yellow' ELSE 'red' END AS status
FROM j
""")
def q_coverage(spark, sf):
    return A.coverage(*_coverage_sides(spark, sf), "k")


@query("coverage_missing", _COVERAGE + "SELECT k FROM r WHERE k NOT IN (SELECT k FROM m)")
def q_coverage_missing(spark, sf):
    return A.missing_keys(*_coverage_sides(spark, sf), "k")


def _coverage_sides(spark, sf):
    # every third nation can be mapped: keys without a partner on both sides
    return (table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")),
            table(spark, sf, "customer").select((F.col("c_nationkey") * 3).alias("k")))

