"""Registered queries for projection / column transforms (PRJ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import transforms as X
from quarry.plans.registry import nullable_ints_as_double, query, table


@query("rename_columns", """
SELECT n_nationkey, n_name AS nation_name, n_regionkey AS region_key FROM nation
""")
def q_rename_columns(spark, sf):
    return X.rename_columns(table(spark, sf, "nation"),
                            {"n_name": "nation_name", "n_regionkey": "region_key", "missing": "x"})


@query("column_overrides", """
SELECT c_custkey, c_name AS name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(trunc(c_acctbal) AS BIGINT) AS c_acctbal
FROM customer
""")
def q_column_overrides(spark, sf):
    return X.apply_column_overrides(table(spark, sf, "customer"), [
        {"column": "c_mktsegment", "drop": True},
        {"column": "c_name", "rename": "name"},
        {"column": "c_nationkey", "dtype": "string"},
        {"column": "c_acctbal", "dtype": "int64"},
        {"column": "not_there", "drop": True},
    ])


@query("null_markers", """
SELECT p_partkey,
       CASE WHEN p_name IN ('Brand#1', 'Brand#2', 'NA') THEN NULL ELSE p_name END AS p_name,
       CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'NA') THEN NULL ELSE p_brand END AS p_brand,
       CASE WHEN p_type IN ('Brand#1', 'Brand#2', 'NA') THEN NULL ELSE p_type END AS p_type,
       p_size, p_retailprice
FROM part
""")
def q_null_markers(spark, sf):
    return X.replace_null_markers(table(spark, sf, "part"), ["Brand#1", "Brand#2", "NA"])


@query("numeric_coercion", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag
FROM lineitem
""")
def q_numeric_coercion(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.col("l_quantity").cast("string").alias("l_quantity"),
        F.col("l_extendedprice").cast("string").alias("l_extendedprice"),
        "l_returnflag")
    return X.auto_numeric_coercion(li)


@query("type_coercion", """
SELECT o_orderkey, o_orderdate, CAST(o_custkey AS BIGINT) AS o_custkey, o_totalprice,
       lower(o_orderstatus) AS o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_day
FROM orders
""")
def q_type_coercion(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").cast("string").alias("o_orderdate"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" ")).alias("o_orderstatus"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_day"))
    return X.coerce_types(o, [
        {"column": "o_orderdate", "to_type": "datetime", "format": "%Y-%m-%d %H:%M:%S"},
        {"column": "o_custkey", "to_type": "int"},
        {"column": "o_totalprice", "to_type": "float"},
        {"column": "o_orderstatus", "to_type": "string", "strip": True, "lowercase": True},
        {"column": "order_day", "to_type": "date", "format": "%d/%m/%Y"},
    ]).withColumn("order_day", F.col("order_day").cast("string"))


@query("column_transforms", """
SELECT p_partkey, p_name AS name, upper(p_brand) AS p_brand_up, p_brand, lower(p_type) AS p_type,
       p_size, p_size * 2.5 AS p_size_scaled, p_retailprice, round(p_retailprice, 0) AS price_round
FROM part
""")
def q_column_transforms(spark, sf):
    return X.column_transforms(table(spark, sf, "part"), [
        {"source": "p_name", "target": "name", "transform": "rename"},
        {"source": "p_brand", "target": "p_brand_up", "transform": "uppercase"},
        {"source": "p_type", "transform": "lowercase"},
        {"source": "p_size", "target": "p_size_scaled", "transform": "unit_convert", "args": {"factor": 2.5}},
        {"source": "p_retailprice", "target": "price_round", "transform": "round", "args": {"decimals": 0}},
        {"source": "absent", "transform": "strip"},
    ])


@query("unit_convert", """
SELECT p_partkey, p_size * 1000.0 AS p_size FROM part
""")
def q_unit_convert(spark, sf):
    return X.unit_convert(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "um", "nm")


@query("units_policy", """
SELECT p_partkey, p_size * 1000000.0 AS p_size, p_retailprice * 0.1 AS p_retailprice FROM part
""")
def q_units_policy(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return X.apply_units_policy(p, "normalize", {"p_size": "mm", "p_retailprice": "angstrom"})


@query("calculated_column", """
SELECT l_orderkey, l_linenumber,
       CAST(round(CAST(CAST(l_extendedprice * l_discount AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) AS disc_value,
       CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END AS qty_per_tax
FROM lineitem
""")
def q_calculated_column(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount",
                                             "l_quantity", "l_tax")
    li = X.calculated_column(li, "disc_value", "l_extendedprice", "*", "l_discount", round_to=2)
    li = X.calculated_column(li, "qty_per_tax", "l_quantity", "/", "l_tax")
    return li.select("l_orderkey", "l_linenumber", "disc_value", "qty_per_tax")


@query("mask_columns", """
SELECT c_custkey, repeat('*', length(c_name)) AS c_name, '********' AS c_mktsegment FROM customer
""")
def q_mask_columns(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    c = X.mask_columns(c, ["c_name"])
    return X.mask_columns(c, ["c_mktsegment"], preserve_length=False)


@query("derive_regex", r"""
SELECT p_partkey, p_brand,
       CASE WHEN regexp_matches(p_brand, '#(\d+)$') THEN regexp_extract(p_brand, '#(\d+)$', 1) END AS brand_no,
       CASE WHEN regexp_matches(p_name, '^(\w+) ring') THEN regexp_extract(p_name, '^(\w+) ring', 1) END AS ring_kind
FROM part
""")
def q_derive_regex(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    p = X.derive_regex(p, "p_brand", r"#(\d+)$", "brand_no")
    return X.derive_regex(p, "p_name", r"^(\w+) ring", "ring_kind").drop("p_name")


@query("derive_lookup", """
SELECT o_orderkey, o_orderpriority,
       CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS DOUBLE)
       AS prio_rank
FROM orders
""")
def q_derive_lookup(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    out = X.derive_lookup(o, "o_orderpriority", {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}, "prio_rank")
    return nullable_ints_as_double(out, "prio_rank")


@query("alias_resolve", """
SELECT c_custkey, c_mktsegment,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment
            WHEN c_mktsegment = 'AUTOMOBILE' THEN 'AUTO'
            WHEN c_mktsegment = 'HOUSEHOLD' THEN 'HOME' END AS segment
FROM customer
""")
def q_alias_resolve(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return X.resolve_alias(c, "c_mktsegment", ["BUILDING", "MACHINERY"],
                           {"AUTOMOBILE": "AUTO", "HOUSEHOLD": "HOME"}, target="segment")


@query("mapped_record", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       '$' || format('{:,.2f}', o_totalprice) AS price,
       lower(o_orderstatus) AS status,
       'n/a' AS missing_col
FROM orders
""")
def q_mapped_record(spark, sf):
    return X.mapped_record(table(spark, sf, "orders"), [
        {"target": "price", "source": "o_totalprice", "transform": "currency"},
        {"target": "status", "source": "o_orderstatus", "transform": "lowercase", "default": "unknown"},
        {"target": "missing_col", "source": "nope", "default": "n/a"},
    ])


@query("format_values", """
SELECT c_custkey,
       '$' || format('{:,.2f}', c_acctbal) AS usd,
       '€' || format('{:,.2f}', c_acctbal) AS eur,
       format('{:.1f}', c_acctbal) || '%' AS pct,
       upper(c_mktsegment) AS seg_upper,
       lower(c_name) AS name_lower,
       array_to_string(list_transform(regexp_extract_all(c_name, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS name_title
FROM customer
""")
def q_format_values(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        X.format_value(F.col("c_acctbal"), "currency", "USD").alias("usd"),
        X.format_value(F.col("c_acctbal"), "currency", "EUR").alias("eur"),
        X.format_value(F.col("c_acctbal"), "percentage").alias("pct"),
        X.format_value(F.col("c_mktsegment"), "uppercase").alias("seg_upper"),
        X.format_value(F.col("c_name"), "lowercase").alias("name_lower"),
        X.format_value(F.col("c_name"), "title").alias("name_title"))


@query("iso_utc", """
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS ts_iso FROM events
""")
def q_iso_utc(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", X.iso_utc(F.col("ts")).alias("ts_iso"))



@query("unit_convert_by_row", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size / 1000.0 WHEN 1 THEN p_size * 1.0 WHEN 2 THEN p_size * 1000.0 END AS um FROM part
""")
def q_unit_convert_by_row(spark, sf):
    # nm, um, mm and an unknown unit by row; every fifth size is text that is no number in the second column
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("um"),
                                        F.element_at(F.array(*map(F.lit, ("nm", "um", "mm", "ell"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("unit"))
    return X.unit_convert(p, "um", to_unit="um", unit_column="unit").drop("unit")


@query("unit_convert_bad_cells", """
SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_size * 1000.0 END AS size FROM part
""")
def q_unit_convert_bad_cells(spark, sf):
    size = F.when(F.col("p_partkey") % 5 > 0, F.col("p_size").cast("string")).otherwise("n/a")
    return X.unit_convert(table(spark, sf, "part").select("p_partkey", size.alias("size")), "size", "um", "nm")
