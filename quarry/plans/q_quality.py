"""Registered queries for validation / data quality (VAL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import quality as Q
from quarry.plans.registry import query, rounded, table


@query("value_constraints", """
SELECT 'lineitem' AS table_name, rule, column_name, violations, 'error' AS severity, violations = 0 AS passed FROM (
  SELECT 'below_min' AS rule, 'l_quantity' AS column_name, count(*) FILTER (WHERE l_quantity < 5) AS violations FROM lineitem
  UNION ALL SELECT 'above_max', 'l_quantity', count(*) FILTER (WHERE l_quantity > 45) FROM lineitem
  UNION ALL SELECT 'above_max', 'l_discount', count(*) FILTER (WHERE l_discount > 0.08) FROM lineitem
  UNION ALL SELECT 'not_null', 'l_shipdate', count(*) FILTER (WHERE l_shipdate IS NULL) FROM lineitem
  UNION ALL SELECT 'regex', 'l_returnflag',
                   count(*) FILTER (WHERE l_returnflag IS NOT NULL AND NOT regexp_matches(l_returnflag, '^[AR]$')) FROM lineitem)
""")
def q_value_constraints(spark, sf):
    return Q.value_constraints(table(spark, sf, "lineitem"), {
        "l_quantity": {"min": 5, "max": 45},
        "l_discount": {"max": 0.08},
        "l_shipdate": {"not_null": True},
        "l_returnflag": {"regex": "^[AR]$"},
        "absent": {"min": 0},
    }, table_name="lineitem")


@query("unique_check", """
SELECT 'orders' AS table_name, 'unique' AS rule, 'o_orderkey' AS column_name,
       count(*) - (count(DISTINCT o_orderkey) + max(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END)) AS violations,
       'error' AS severity FROM orders
UNION ALL SELECT 'orders', 'unique', 'o_custkey',
       count(*) - (count(DISTINCT o_custkey) + max(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END)), 'error' FROM orders
UNION ALL SELECT 'lineitem', 'unique', 'l_orderkey',
       count(*) - (count(DISTINCT l_orderkey) + max(CASE WHEN l_orderkey IS NULL THEN 1 ELSE 0 END)), 'error' FROM lineitem
UNION ALL SELECT 'lineitem', 'required', 'l_comment', 1, 'error'
UNION ALL SELECT 'lineitem', 'type_float', 'l_quantity', 0, 'error'
UNION ALL SELECT 'orders', 'type_datetime', 'o_orderdate', 0, 'error'
""")
def q_unique_check(spark, sf):
    o = Q.schema_rules(table(spark, sf, "orders"), types={"o_orderdate": "datetime"},
                       unique=["o_orderkey", "o_custkey"], table_name="orders")
    li = Q.schema_rules(table(spark, sf, "lineitem"), required=["l_comment"], types={"l_quantity": "float"},
                        unique=["l_orderkey"], table_name="lineitem")
    return o.unionByName(li).drop("passed")


_ROW_RULES = [
    {"name": "price_positive", "expr": "l_extendedprice > 0", "on_fail": "error"},
    {"name": "disc_or_tax", "expr": "l_discount < 0.05 OR l_tax > 0.04", "on_fail": "warn"},
    {"name": "flag_status", "expr": "NOT (l_returnflag = 'N' AND l_linestatus = 'X')", "on_fail": "warn"},
]


@query("row_rules", """
SELECT 'lineitem' AS table_name, rule, '' AS column_name, violations, severity, violations = 0 AS passed FROM (
  SELECT 'price_positive' AS rule, count(*) FILTER (WHERE NOT coalesce(l_extendedprice > 0, false)) AS violations,
         'error' AS severity FROM lineitem
  UNION ALL SELECT 'disc_or_tax', count(*) FILTER (WHERE NOT coalesce(l_discount < 0.05 OR l_tax > 0.04, false)),
         'warning' FROM lineitem
  UNION ALL SELECT 'flag_status', count(*) FILTER (WHERE NOT coalesce(NOT (l_returnflag = 'N' AND l_linestatus = 'X'), false)),
         'warning' FROM lineitem)
""")
def q_row_rules(spark, sf):
    return Q.row_rules(table(spark, sf, "lineitem"), _ROW_RULES, table_name="lineitem")


@query("aggregate_rules", """
SELECT 'orders' AS table_name, rule, column_name, value, passed FROM (
  SELECT 'row_count' AS rule, '' AS column_name, CAST(count(*) AS DOUBLE) AS value,
         count(*) >= 100 AND count(*) <= 10000000 AS passed FROM orders
  UNION ALL SELECT 'unique_count', 'o_orderpriority', CAST(count(DISTINCT o_orderpriority) AS DOUBLE),
         count(DISTINCT o_orderpriority) >= 6 FROM orders
  UNION ALL SELECT 'null_ratio', 'o_orderstatus', round(count(*) FILTER (WHERE o_orderstatus IS NULL) / count(*), 6),
         count(*) FILTER (WHERE o_orderstatus IS NULL) / count(*) <= 0.1 FROM orders)
""")
def q_aggregate_rules(spark, sf):
    return rounded(Q.aggregate_rules(table(spark, sf, "orders"), [
        {"type": "row_count", "min": 100, "max": 10_000_000},
        {"type": "unique_count", "column": "o_orderpriority", "min": 6},
        {"type": "null_ratio", "column": "o_orderstatus", "max": 0.1},
    ], table_name="orders"))


@query("validation_summary", """
WITH r AS (
  SELECT 'nation' AS table_name, 'error' AS severity, count(*) FILTER (WHERE n_regionkey > 3) AS v FROM nation
  UNION ALL SELECT 'nation', 'warning', count(*) FILTER (WHERE NOT coalesce(n_nationkey < 20, false)) FROM nation
  UNION ALL SELECT 'region', 'error', count(*) FILTER (WHERE r_regionkey > 10) FROM region
  UNION ALL SELECT 'orders', 'warning', count(*) FILTER (WHERE o_totalprice > 400000) FROM orders
  UNION ALL SELECT 'orders', 'error', count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('F', 'O', 'P'), false)) FROM orders)
SELECT table_name, CAST(count(*) FILTER (WHERE v > 0 AND severity = 'error') AS BIGINT) AS errors,
       CAST(count(*) FILTER (WHERE v > 0 AND severity = 'warning') AS BIGINT) AS warnings,
       count(*) FILTER (WHERE v > 0 AND severity = 'error') = 0 AS valid
FROM r GROUP BY 1
UNION ALL SELECT 'parts', 0, 1, true
""")
def q_validation_summary(spark, sf):
    n = table(spark, sf, "nation")
    r1 = Q.value_constraints(n, {"n_regionkey": {"max": 3}}, table_name="nation")
    r2 = Q.row_rules(n, [{"name": "key_small", "expr": "n_nationkey < 20"}], table_name="nation")
    r3 = Q.value_constraints(table(spark, sf, "region"), {"r_regionkey": {"max": 10}}, table_name="region")
    o = table(spark, sf, "orders")
    r4 = Q.value_constraints(o, {"o_totalprice": {"max": 400000}}, table_name="orders", severity="warning")
    r5 = Q.row_rules(o, [{"name": "status_known", "expr": "o_orderstatus IN ('F', 'O', 'P')", "on_fail": "error"}],
                     table_name="orders")
    return Q.validation_summary([r1, r2, r3, r4, r5], expected_tables=["nation", "region", "orders", "parts"])


_QRULES = {"qty_range": "l_quantity BETWEEN 5 AND 45", "discount_cap": "l_discount <= 0.08"}


@query("quarantine_split", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount,
       concat_ws(',', CASE WHEN NOT coalesce(l_quantity BETWEEN 5 AND 45, false) THEN 'qty_range' END,
                      CASE WHEN NOT coalesce(l_discount <= 0.08, false) THEN 'discount_cap' END) AS failed_rules
FROM lineitem
WHERE NOT coalesce(l_quantity BETWEEN 5 AND 45, false) OR NOT coalesce(l_discount <= 0.08, false)
""")
def q_quarantine_split(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    _good, bad = Q.quarantine_split(li, _QRULES)
    return bad.withColumn("failed_rules", F.array_join("failed_rules", ","))


@query("factor_levels_check", """
SELECT 'required_columns' AS "check", true AS passed, '' AS detail
UNION ALL SELECT 'numeric_response', true, 'l_quantity'
UNION ALL SELECT 'min_rows', count(*) >= 10, CAST(count(*) AS VARCHAR) FROM lineitem
UNION ALL SELECT 'null_share', count(*) FILTER (WHERE l_quantity IS NULL) / count(*) <= 0.5,
                 CAST(count(*) FILTER (WHERE l_quantity IS NULL) AS VARCHAR) FROM lineitem
UNION ALL SELECT 'levels_l_returnflag', count(DISTINCT l_returnflag) >= 2, CAST(count(DISTINCT l_returnflag) AS VARCHAR) FROM lineitem
UNION ALL SELECT 'levels_l_linestatus', count(DISTINCT l_linestatus) >= 2, CAST(count(DISTINCT l_linestatus) AS VARCHAR) FROM lineitem
""")
def q_factor_levels_check(spark, sf):
    return Q.factor_levels_check(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


#: Orders of a document, about: a nation's orders are cut in as many documents as that takes.
_DOC_ORDERS = 50_000

# Profiles in the contract's layout, over JSON documents of a nation built from customer and orders.
_PROFILE = {
    "schema_version": "1.0.0", "version": 1,
    "meta": {"profile_id": "orders-by-nation", "title": "Orders"},
    "datasource": {"id": "json", "format": "json", "filters": {"type": "group", "op": "AND", "children": [
        {"type": "predicate", "field": "filename", "op": "endswith", "value": ".JSON", "case": "insensitive"}]}},
    "population": {"default_strategy": "dear", "strategies": {"dear": {"type": "valid_only", "exclude_rules": [
        {"column": "o_orderpriority", "condition": "contains", "value": "^5"}]}}},
    "context_defaults": {"defaults": {"site": "here"}, "content_patterns": [{"field": "nation", "path": "$.meta.nation", "required": True, "on_fail": "error"}]},
    "levels": [{"name": "run", "tables": [{
        "id": "orders", "label": "Orders", "select": {"strategy": "array_of_objects", "path": "$.orders[*]"},
        "stable_columns": ["o_orderkey", "o_totalprice"], "stable_columns_subset": True,
        "validation_constraints": [{"column": "o_totalprice", "type": "range", "min": 2000, "max": 400000}, {"column": "o_orderkey", "type": "not_null"}],
        "column_transforms": [{"source": "o_totalprice", "target": "kilo", "transform": "unit_convert", "args": {"factor": 0.001}}]}]}],
    "normalization": {"numeric_coercion": True, "nan_values": ["3-MEDIUM"]},
    "row_filters": [{"column": "o_orderstatus", "op": "in", "values": ["O", "F"]}],
    "type_coercion": [{"column": "o_orderkey", "to_type": "string"}],
    "calculated_columns": [{"name": "half", "left": "o_totalprice", "op": "/", "right": 2}],
    "column_renames": {"o_totalprice": "price"},
    "row_rules": [{"name": "status_known", "expression": "o_orderstatus IN ('O', 'F', 'P')", "on_fail": "error"}],
    "on_validation_fail": "quarantine", "quarantine_table": "failed",
    "outputs": {
        "defaults": [{"id": "export", "from_level": "run", "from_tables": ["orders"], "include_context": True}],
        "optional_outputs": [{"id": "extra", "from_level": "run", "from_tables": ["by_status"], "include_context": False}],
        "aggregations": [{"id": "a", "from_table": "orders", "group_by": ["nation", "o_orderstatus"], "aggregations": {"price": "count"}, "output_table": "by_status"}]},
}


def _run_profile(spark, sf, **kw):
    from quarry.plans.profile import run_profile
    from quarry.session import scratch_path

    folder = scratch_path(spark, "profile-docs")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    # a document is one task's: its size must not follow the table's
    parts = -(-table(spark, sf, "orders").count() // (_DOC_ORDERS * max(1, table(spark, sf, "nation").count())))
    docs = o.groupBy("c_nationkey", F.pmod(F.xxhash64("o_orderkey"), F.lit(max(1, parts))).alias("part")).agg(
        F.struct(F.col("c_nationkey").cast("string").alias("nation")).alias("meta"),
        F.collect_list(F.struct("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")).alias("orders"))
    docs.withColumn("k", F.col("c_nationkey")).drop("c_nationkey").write.partitionBy("k", "part").json(folder)
    return run_profile(spark, _PROFILE, folder, **kw)["tables"]


_PROFILE_ROWS = """
WITH o AS (SELECT o.*, c_nationkey::VARCHAR AS nation FROM orders o JOIN customer ON o_custkey = c_custkey WHERE NOT regexp_matches(o_orderpriority, '^5')),
good AS (SELECT * FROM o WHERE o_totalprice BETWEEN 2000 AND 400000 AND o_orderstatus IN ('O', 'F', 'P')),
kept AS (SELECT *, o_orderkey::VARCHAR AS k FROM good WHERE o_orderstatus IN ('O', 'F'))
"""


@query("run_profile_tables", _PROFILE_ROWS + """
SELECT k AS o_orderkey, o_totalprice AS price, o_orderstatus, nullif(o_orderpriority, '3-MEDIUM') AS o_orderpriority, CAST(nation AS DOUBLE) AS nation, 'here' AS site,
       round(o_totalprice * 0.001, 6) AS kilo, round(o_totalprice / 2, 6) AS half FROM kept
""")
def q_run_profile_tables(spark, sf):
    return rounded(_run_profile(spark, sf)["orders"].drop("file_path"))


@query("run_profile_quarantine", _PROFILE_ROWS + """
SELECT o_orderkey, o_totalprice, nation, 'orders' AS __table_id__, concat_ws(',', CASE WHEN o_totalprice < 2000 THEN 'o_totalprice:min' END,
       CASE WHEN o_totalprice > 400000 THEN 'o_totalprice:max' END, CASE WHEN o_orderstatus NOT IN ('O', 'F', 'P') THEN 'status_known' END) AS failed
FROM o WHERE o_totalprice NOT BETWEEN 2000 AND 400000 OR o_orderstatus NOT IN ('O', 'F', 'P')
""")
def q_run_profile_quarantine(spark, sf):
    failed = _run_profile(spark, sf)["failed"]
    return failed.select("o_orderkey", "o_totalprice", "nation", "__table_id__", F.array_join("failed_rules", ",").alias("failed"))


@query("run_profile_outputs", _PROFILE_ROWS + """
SELECT 'extra' AS output, CAST(nation AS DOUBLE) AS nation, o_orderstatus, count(*) AS n FROM kept GROUP BY ALL
UNION ALL SELECT 'export', CAST(nation AS DOUBLE), NULL, count(*) FROM kept GROUP BY ALL
""")
def q_run_profile_outputs(spark, sf):
    tables = _run_profile(spark, sf, selected_outputs=["extra"])
    extra = tables["extra"].select(F.lit("extra").alias("output"), "nation", "o_orderstatus", F.col("price_count").alias("n"))
    return extra.unionByName(tables["export"].groupBy("nation").agg(F.count("*").alias("n")).select(
        F.lit("export").alias("output"), "nation", F.lit(None).cast("string").alias("o_orderstatus"), "n"))


_LEVELS = {
    "schema_version": "1.0.0", "version": 1, "meta": {"profile_id": "levels"},
    "contexts": [{"name": "run", "level": "run", "paths": ["$.meta"], "key_map": {"nation": "$.meta.nation"}},
                 {"name": "image", "level": "image", "paths": ["$.images[*]"], "key_map": {"image_segment": "$.segment"}}],
    "levels": [{"name": "run", "tables": [{"id": "rows", "select": {"strategy": "array_of_objects", "path": "$.orders[*]"},
                                           "validation_constraints": [{"column": "o_totalprice", "type": "range", "max": 400000}]}]},
               {"name": "image", "tables": [{"id": "rows", "select": {"strategy": "array_of_objects", "path": "$.images[*]"},
                                             "validation_constraints": [{"column": "balance", "type": "range", "min": 0}]}]}],
    "on_validation_fail": "quarantine",
    "outputs": {"defaults": [{"id": "out", "from_level": "run", "from_tables": ["rows"], "include_run_context": True, "include_image_context": False}]},
}
_LEVEL_ROWS = """
WITH r AS (SELECT o_orderkey, o_totalprice, NULL AS image_id, NULL AS balance, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey
           UNION ALL SELECT NULL, NULL, c_custkey, c_acctbal, c_nationkey FROM customer),
bad AS (SELECT *, coalesce(o_totalprice > 400000, false) OR coalesce(balance < 0, false) AS wrong FROM r)
"""


def _run_levels(spark, sf, **kw):
    from quarry.plans.profile import run_profile
    from quarry.session import scratch_path

    folder = scratch_path(spark, "level-docs")
    c = table(spark, sf, "customer")
    orders = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("orders"))
    images = c.groupBy("c_nationkey").agg(F.collect_list(F.struct(F.col("c_custkey").alias("image_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))).alias("images"))
    docs = orders.join(images, "c_nationkey").select(F.struct(F.col("c_nationkey").cast("string").alias("nation")).alias("meta"), "orders", "images", F.col("c_nationkey").alias("k"))
    docs.write.partitionBy("k").json(folder)
    return run_profile(spark, _LEVELS, folder, **kw)["tables"]


@query("run_profile_levels", _LEVEL_ROWS + """
SELECT c_nationkey::BIGINT AS nation, count(*) FILTER (NOT wrong) AS kept, count(*) FILTER (o_totalprice > 400000) AS dear, count(*) FILTER (balance < 0) AS in_debt FROM bad GROUP BY 1
""")
def q_run_profile_levels(spark, sf):
    """Two tables share an id in two levels: the rules of both hold."""
    tables = _run_levels(spark, sf)
    kept = tables["rows"].groupBy("nation").agg(F.count("*").alias("kept"))
    rule = lambda r: F.count_if(F.array_contains("failed_rules", r))
    failed = tables["validation_failures"].groupBy("nation").agg(rule("o_totalprice:max").alias("dear"), rule("balance:min").alias("in_debt"))
    return kept.join(failed, "nation", "left").na.fill(0).withColumn("nation", F.col("nation").cast("long"))


@query("run_profile_toggles", _LEVEL_ROWS + """
SELECT 'run' AS shown, CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n FROM bad WHERE NOT wrong GROUP BY ALL
UNION ALL SELECT 'image', c_mktsegment, count(*) FROM customer WHERE c_acctbal >= 0 GROUP BY ALL
""")
def q_run_profile_toggles(spark, sf):
    """A named output with run context alone, and with image context alone: neither shows the other's columns."""
    run = _run_levels(spark, sf)["out"]
    image = _run_levels(spark, sf, include_run_context=False, include_image_context=True)["out"]
    if "image_segment" in run.columns or "nation" in image.columns:
        raise ValueError("a context that was switched off is shown")
    count = lambda df, c, name: df.groupBy(c.cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("shown", F.lit(name))
    return count(run, F.col("nation").cast("long"), "run").unionByName(count(image.where("image_id IS NOT NULL"), F.col("image_segment"), "image")).select("shown", "value", "n")
