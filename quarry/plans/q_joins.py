"""Registered queries for joins and set operations (JON, SET)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import joins as J
from quarry.plans.registry import nullable_ints_as_double, query, table


def _orders_customers(spark, sf):
    # whole tables on keys without a partner on both sides: customers by twice their key
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("o_custkey"), "c_name", "c_acctbal")
    return o, c


_JOIN_SQL = """
SELECT {okey} AS o_orderkey, {key} AS o_custkey, o.o_totalprice, c.c_name, c.c_acctbal
FROM orders o {how} JOIN (SELECT c_custkey * 2 AS c_custkey, c_name, c_acctbal FROM customer) c
  ON o.o_custkey = c.c_custkey
"""
_NULLABLE_KEY = "CAST(o.o_orderkey AS DOUBLE)"


def _join_query(how, nullable_order_key):
    def q(spark, sf):
        o, c = _orders_customers(spark, sf)
        out = J.output_join(o, c, ["o_custkey"], how)
        return nullable_ints_as_double(out, "o_orderkey") if nullable_order_key else out
    return q


query("join_inner", _JOIN_SQL.format(how="INNER", key="o.o_custkey", okey="o.o_orderkey"))(_join_query("inner", False))
query("join_left", _JOIN_SQL.format(how="LEFT", key="o.o_custkey", okey="o.o_orderkey"))(_join_query("left", False))
query("join_right", _JOIN_SQL.format(how="RIGHT", key="c.c_custkey", okey=_NULLABLE_KEY))(_join_query("right", True))
query("join_full", _JOIN_SQL.format(how="FULL", key="coalesce(o.o_custkey, c.c_custkey)",
                                    okey=_NULLABLE_KEY))(_join_query("outer", True))


@query("join_subset_suffix", """
SELECT s.s_suppkey, s.s_name, s.s_nationkey, s.n_name, CAST(n.n_nationkey AS DOUBLE) AS n_nationkey,
       n.n_name AS n_name_joined, CAST(n.n_regionkey AS DOUBLE) AS n_regionkey
FROM (SELECT s_suppkey, s_name, s_nationkey, 'S-' || s_name AS n_name FROM supplier) s
LEFT JOIN (SELECT n_nationkey + 5 AS n_nationkey, n_name, n_regionkey FROM nation) n ON s.s_nationkey = n.n_nationkey
""")
def q_join_subset_suffix(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey",
                                            F.concat(F.lit("S-"), F.col("s_name")).alias("n_name"))
    n = table(spark, sf, "nation").withColumn("n_nationkey", F.col("n_nationkey") + 5)
    out = J.join_with_subset(s, n, "s_nationkey", "n_nationkey", "left", columns=["n_name", "n_regionkey"])
    return nullable_ints_as_double(out, "n_nationkey", "n_regionkey")


@query("semi_join", """
SELECT * FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)
""")
def q_semi_join(spark, sf):
    li = table(spark, sf, "lineitem").filter(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("o_orderkey"))
    return J.semi_join(table(spark, sf, "orders"), li, "o_orderkey")


@query("anti_join", """
SELECT * FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
""")
def q_anti_join(spark, sf):
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return J.anti_join(table(spark, sf, "customer"), o, "c_custkey")


@query("join_three_way", """
SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice, o.o_custkey, o.o_orderdate, c.c_name, c.c_mktsegment
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
""")
def q_join_three_way(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    out = J.three_way(li, o, c, "o_orderkey", "c_custkey")
    return out.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_extendedprice",
                      F.col("c_custkey").alias("o_custkey"), "o_orderdate", "c_name", "c_mktsegment")


@query("double_lookup", """
WITH e AS (SELECT DISTINCT o.o_custkey AS src, l.l_suppkey AS dst
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT e.src, e.dst, n1.n_name AS src_nation, n2.n_name AS dst_nation
FROM e
LEFT JOIN customer c ON e.src = c.c_custkey LEFT JOIN nation n1 ON c.c_nationkey = n1.n_nationkey
LEFT JOIN supplier s ON e.dst = s.s_suppkey LEFT JOIN nation n2 ON s.s_nationkey = n2.n_nationkey
""")
def q_double_lookup(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    edges = (li.join(o, li.l_orderkey == o.o_orderkey)
             .select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct())
    nation = table(spark, sf, "nation")
    src_type = (table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
                .select(F.col("c_custkey").alias("src"), F.col("n_name").alias("src_nation")))
    dst_type = (table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
                .select(F.col("s_suppkey").alias("dst"), F.col("n_name").alias("dst_nation")))
    return J.double_lookup(edges, src_type, dst_type, "src", "dst")


@query("union_diagonal", """
SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, NULL::DOUBLE AS supplier_nation
FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_acctbal, NULL, CAST(s_nationkey AS DOUBLE) FROM supplier
""")
def q_union_diagonal(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                            F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                                            F.col("s_acctbal").alias("acctbal"),
                                            F.col("s_nationkey").cast("bigint").alias("supplier_nation"))
    return nullable_ints_as_double(J.union_diagonal([c, s]), "supplier_nation")


@query("combine_tagged", """
SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey,
       NULL::DOUBLE AS r_regionkey, NULL AS r_name, 'nation' AS __table_id__
FROM nation
UNION ALL
SELECT NULL, NULL, NULL, CAST(r_regionkey AS DOUBLE), r_name, 'region' FROM region
""")
def q_combine_tagged(spark, sf):
    out = J.combine_tagged({"nation": table(spark, sf, "nation"), "region": table(spark, sf, "region")})
    return nullable_ints_as_double(out, "n_nationkey", "n_regionkey", "r_regionkey")


@query("concat_rows", """
SELECT * FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT * FROM orders WHERE o_orderstatus <> 'F'
""")
def q_concat_rows(spark, sf):
    o = table(spark, sf, "orders")
    return J.concat_rows([o.filter(F.col("o_orderstatus") == "F"), o.filter(F.col("o_orderstatus") != "F")])


@query("concat_columns", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS pos FROM nation),
     r AS (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS pos FROM region)
SELECT n.n_nationkey, n.n_name, n.n_regionkey, CAST(r.r_regionkey AS DOUBLE) AS r_regionkey, r.r_name
FROM n FULL JOIN r ON n.pos = r.pos
""")
def q_concat_columns(spark, sf):
    out = J.concat_columns(table(spark, sf, "nation"), table(spark, sf, "region"), ["n_nationkey"], ["r_regionkey"])
    return nullable_ints_as_double(out, "r_regionkey")


@query("dedup_keep_first", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1
""")
def q_dedup_keep_first(spark, sf):
    kept, _stats = J.dedup_keep_first(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return kept


@query("append_defaults", """
SELECT conv_id, turn, role, text, 'model-a' AS model, CAST(length(text) // 4 AS BIGINT) AS tokens,
       length(text) / 4000.0 AS cost
FROM conversations WHERE turn = 0
UNION ALL
SELECT conv_id, turn, role, text, 'unknown', 0, 0.0 FROM conversations WHERE turn > 0
""")
def q_append_defaults(spark, sf):
    conv = table(spark, sf, "conversations")
    target = conv.filter(F.col("turn") == 0).select(
        "conv_id", "turn", "role", "text", F.lit("model-a").alias("model"),
        F.floor(F.length("text") / 4).cast("bigint").alias("tokens"),
        (F.length("text") / 4000.0).alias("cost"))
    old_rows = conv.filter(F.col("turn") > 0)
    return J.append_with_defaults(target, old_rows, {"model": "unknown", "tokens": 0, "cost": 0.0})
