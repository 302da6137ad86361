"""Registered queries for the declared-only options (OPT-01, 03, 04, 05, 06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import aggregates as A
from quarry.operators import search as S
from quarry.operators import stats as ST
from quarry.plans.registry import query, rounded, table


@query("group_means", """
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std,
       round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS se,
       round(avg(l_quantity) - 1.959963984540054 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS ci_low,
       round(avg(l_quantity) + 1.959963984540054 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS ci_high
FROM lineitem GROUP BY 1
""")
def q_group_means(spark, sf):
    return rounded(ST.group_means(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity"))


_LI_COLS = [("l_orderkey", True), ("l_partkey", True), ("l_suppkey", True), ("l_linenumber", True),
            ("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_tax", True),
            ("l_returnflag", False), ("l_linestatus", False), ("l_shipdate", False)]


@query("factor_detection", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CASE WHEN {str(num).lower()} AND count({c}) >= 10 THEN 'response' "
    f"WHEN NOT {str(num).lower()} AND count(DISTINCT {c}) <= 100 THEN 'factor' ELSE 'other' END AS role, "
    f"count(DISTINCT {c}) AS distinct_count, count({c}) AS non_null FROM lineitem" for c, num in _LI_COLS))
def q_factor_detection(spark, sf):
    return ST.detect_roles(table(spark, sf, "lineitem"))


@query("response_transform", """
SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_quantity), 9) AS log_qty, round(sqrt(l_quantity), 9) AS sqrt_qty,
       round(CASE WHEN l_discount = 0 THEN NULL ELSE 1.0 / l_discount END, 9) AS inv_disc
FROM lineitem WHERE l_returnflag <> 'N'
""")
def q_response_transform(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                             "l_discount", "l_returnflag")
    li = ST.transform_response(li, "l_quantity", "log", where="l_returnflag <> 'N'", out="log_qty")
    li = ST.transform_response(li, "l_quantity", "sqrt", out="sqrt_qty")
    li = ST.transform_response(li, "l_discount", "inverse", out="inv_disc")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round("log_qty", 9).alias("log_qty"),
                     F.round("sqrt_qty", 9).alias("sqrt_qty"), F.round("inv_disc", 9).alias("inv_disc"))


@query("median_3sigma", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS l_extendedprice_median,
       round(3 * stddev_samp(l_extendedprice), 6) AS l_extendedprice_3sigma,
       round(quantile_cont(l_quantity, 0.5), 6) AS l_quantity_median
FROM lineitem GROUP BY 1
""")
def q_median_3sigma(spark, sf):
    return rounded(A.metric_aggregations(table(spark, sf, "lineitem"), ["l_returnflag"],
                                         {"l_extendedprice": ["median", "3sigma"], "l_quantity": ["median"]}))


_BM25_Q = [("b1", "elle ment"), ("b2", "then thein"), ("b3", "nothingmatcheshere")]


def _bm25_sql(k: int) -> str:
    terms = sorted({t for _q, s in _BM25_Q for t in s.split()})
    qrows = ", ".join(f"('{q}', '{t}')" for q, s in _BM25_Q for t in sorted(set(s.split())))
    tl = ", ".join(f"'{t}'" for t in terms)
    return rf"""
WITH toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t FROM documents),
st AS (SELECT count(*) AS N, avg(len(t)) AS avgdl FROM toks),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (
         SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN ({tl}) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT tf.doc_id, tf.term, ln((st.N - df.df + 0.5) / (df.df + 0.5) + 1.0) * tf.tf * 2.2
             / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * tf.dl / st.avgdl)) AS w FROM tf JOIN df USING (term), st),
q(query_id, term) AS (VALUES {qrows}),
s AS (SELECT q.query_id, w.doc_id, sum(w.w) AS score FROM w JOIN q USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM s QUALIFY rank <= {k}
"""


@query("bm25", _bm25_sql(10))
def q_bm25(spark, sf):
    hits = S.bm25_search(table(spark, sf, "documents"), "doc_id", "text", _BM25_Q, top_k=10)
    return hits.withColumn("score", F.round("score", 6))
