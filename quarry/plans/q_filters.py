"""Registered queries for filters, sampling, sorting and paging (FLT, SRT, WIN)."""

from __future__ import annotations

import datetime as dt

from quarry.operators import filters as FL
from quarry.operators import sorting as S
from quarry.plans.registry import query, rounded, table


@query("row_filters", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag, l_shipdate
FROM lineitem
WHERE l_quantity >= 10 AND l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag IN ('A', 'R')
  AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_linenumber <> 3
""")
def q_row_filters(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                             "l_returnflag", "l_shipdate")
    return FL.apply_row_filters(li, [
        {"column": "l_quantity", "op": "gte", "value": 10},
        {"column": "l_discount", "op": "between", "min": 0.02, "max": 0.06},
        {"column": "l_returnflag", "op": "in", "values": ["A", "R"]},
        {"column": "l_shipdate", "op": "lt", "value": dt.datetime(1996, 1, 1)},
        {"column": "l_linenumber", "op": "not_equals", "value": 3},
        {"column": "no_such_column", "op": "equals", "value": 1},
    ])


@query("row_filters_string", """
SELECT * FROM part
WHERE regexp_matches(p_name, 'ring|widget') AND starts_with(p_brand, 'Brand#1')
  AND ends_with(p_type, 'Y') AND p_size > 5 AND p_size <= 40 AND p_name IS NOT NULL
  AND p_retailprice NOT IN (900.0, 901.0)
""")
def q_row_filters_string(spark, sf):
    return FL.apply_row_filters(table(spark, sf, "part"), [
        {"column": "p_name", "op": "contains", "value": "ring|widget"},
        {"column": "p_brand", "op": "startswith", "value": "Brand#1"},
        {"column": "p_type", "op": "endswith", "value": "Y"},
        {"column": "p_size", "op": "gt", "value": 5},
        {"column": "p_size", "op": "lte", "value": 40},
        {"column": "p_name", "op": "is_not_null"},
        {"column": "p_retailprice", "op": "not_in", "values": [900.0, 901.0]},
    ])


@query("ci_filter", """
SELECT * FROM customer WHERE lower(c_mktsegment) = 'building' AND c_nationkey = 3
""")
def q_ci_filter(spark, sf):
    return FL.case_insensitive_filter(table(spark, sf, "customer"),
                                      {"c_mktsegment": "Building", "c_nationkey": 3, "c_name": "all"})


@query("valid_only", """
SELECT * FROM orders WHERE NOT (o_orderstatus = 'P') AND NOT contains(o_orderpriority, 'LOW')
""")
def q_valid_only(spark, sf):
    return FL.valid_only(table(spark, sf, "orders"), [
        {"column": "o_orderstatus", "condition": "equals", "value": "P"},
        {"column": "o_orderpriority", "condition": "contains", "value": "LOW"},
    ])


@query("valid_only_regex", """
SELECT * FROM part WHERE NOT regexp_matches(p_name, 'ring|widget') AND p_size <> 7 AND p_brand IS NOT NULL
""")
def q_valid_only_regex(spark, sf):
    return FL.valid_only(table(spark, sf, "part"), [
        {"column": "p_name", "condition": "contains", "value": "ring|widget"},
        {"column": "p_size", "condition": "equals", "value": 7},
        {"column": "p_brand", "condition": "is_null"},
        {"column": "absent", "value": 1},
    ])


@query("population_apply_to", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem),
     s AS (SELECT l.* FROM lineitem l, q WHERE l.l_extendedprice BETWEEN a - 0.25 * (b - a) AND b + 0.25 * (b - a)),
     r AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM s)
SELECT s.l_orderkey, s.l_linenumber, s.l_extendedprice, s.l_quantity FROM s, r
WHERE s.l_quantity BETWEEN r.a - 0.25 * (r.b - r.a) AND r.b + 0.25 * (r.b - r.a)
""")
def q_population_apply_to(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return FL.population(li, "outliers_excluded", {"method": "iqr", "threshold": 0.25, "apply_to": ["l_extendedprice", "l_quantity"]})


@query("population_all_numeric", """
WITH s AS (SELECT p_size, p_retailprice FROM part),
     a AS (SELECT avg(p_size) AS m, stddev_samp(p_size) AS d FROM s),
     t AS (SELECT s.* FROM s, a WHERE abs((p_size - m) / d) <= 1.5),
     b AS (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS d FROM t)
SELECT t.* FROM t, b WHERE abs((p_retailprice - m) / d) <= 1.5
""")
def q_population_all_numeric(spark, sf):
    return FL.population(table(spark, sf, "part").select("p_size", "p_retailprice"), "outliers_excluded", {"method": "zscore"})


@query("outliers_iqr", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT e.event_id, e.value FROM events e, q
WHERE e.value BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1)
""")
def q_outliers_iqr(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return FL.outliers_iqr(e, ["value"], 1.5)


@query("outliers_zscore", """
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
SELECT e.event_id, e.value FROM events e, s WHERE abs((e.value - s.m) / s.sd) <= 2.0
""")
def q_outliers_zscore(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return FL.outliers_zscore(e, ["value"], 2.0)


@query("outliers_percentile", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi
           FROM lineitem)
SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice FROM lineitem l, q
WHERE l.l_extendedprice BETWEEN q.lo AND q.hi
""")
def q_outliers_percentile(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return FL.outliers_percentile(li, ["l_extendedprice"], 5.0)


@query("first_n", """
SELECT * FROM orders ORDER BY o_orderkey LIMIT 100
""")
def q_first_n(spark, sf):
    return FL.first_n(table(spark, sf, "orders"), 100, ["o_orderkey"])


@query("sample_n", """
SELECT * FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || '42'), c_custkey LIMIT 100
""")
def q_sample_n(spark, sf):
    return FL.sample_n(table(spark, sf, "customer"), 100, ["c_custkey"], seed=42)


@query("sample_stratified", """
WITH c AS (SELECT o_orderpriority, count(*) AS cnt FROM orders GROUP BY 1),
     t AS (SELECT sum(cnt) AS total FROM c),
     r AS (SELECT o.*, row_number() OVER (PARTITION BY o.o_orderpriority
                                          ORDER BY md5(CAST(o.o_orderkey AS VARCHAR) || '42'), o.o_orderkey) AS rn
           FROM orders o)
SELECT r.o_orderkey, r.o_custkey, r.o_orderstatus, r.o_totalprice, r.o_orderdate, r.o_orderpriority
FROM r JOIN c USING (o_orderpriority), t
WHERE r.rn <= greatest(1, CAST(floor(c.cnt * 500 / t.total) AS BIGINT))
""")
def q_sample_stratified(spark, sf):
    return FL.sample_stratified(table(spark, sf, "orders"), "o_orderpriority", 500, ["o_orderkey"], seed=42)


@query("catalog_query", """
SELECT * FROM orders
WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31'
  AND contains(lower(o_orderpriority), 'high')
ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10
""")
def q_catalog_query(spark, sf):
    return FL.catalog_query(table(spark, sf, "orders"), type_col="o_orderstatus", type_value="F",
                            name_col="o_orderpriority", name_like="HIGH",
                            date_col="o_orderdate", date_from=dt.datetime(1995, 1, 1),
                            date_to=dt.datetime(1997, 12, 31), order_col="o_orderdate", id_col="o_orderkey",
                            limit=50, offset=10)


@query("preview", """
SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM customer) AS total_rows
FROM customer ORDER BY c_custkey LIMIT 100
""")
def q_preview(spark, sf):
    rows, _total = S.preview(table(spark, sf, "customer"), 100, ["c_custkey"], ["c_custkey", "c_name", "c_acctbal"])
    return rows


@query("cursor_page", """
WITH cur AS (SELECT o_orderdate AS cd, o_orderkey AS ck FROM orders WHERE o_orderkey = 500)
SELECT o.* FROM orders o, cur
WHERE o.o_orderdate < cur.cd OR (o.o_orderdate = cur.cd AND o.o_orderkey < cur.ck)
ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 25
""")
def q_cursor_page(spark, sf):
    return S.cursor_page(table(spark, sf, "orders"), sort_col="o_orderdate", id_col="o_orderkey",
                         cursor_id=500, descending=True, limit=25)


@query("topk", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20
""")
def q_topk(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return S.top_k(li, "l_extendedprice", 20, ["l_orderkey", "l_linenumber"])


@query("running_budget", """
SELECT o_custkey, o_orderkey, o_totalprice, round(running, 6) AS running FROM (
  SELECT o_custkey, o_orderkey, o_totalprice,
         sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM orders) WHERE running <= 500000
""")
def q_running_budget(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return rounded(S.running_budget(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 500000.0)
                   .drop("o_orderdate"))

