"""Registered queries for readers, probes and sinks (SRC, SNK).

Round-trip queries write the driver's table to a folder under the shared
checkpoint directory and read it back with the library's readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.session import scratch_path
from quarry.sources import readers as R
from quarry.sources import sinks as K
from quarry.sources.probe import probe_schema
from quarry.plans.registry import query, table


@query("scan_csv_roundtrip", """
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation
""")
def q_scan_csv_roundtrip(spark, sf):
    out = scratch_path(spark, "nation-csv")
    table(spark, sf, "nation").write.mode("overwrite").option("header", True).csv(out)
    return R.read_delimited(spark, out + "/*.csv")


@query("json_lines", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_lines(spark, sf):
    out = scratch_path(spark, "events-jsonl")
    table(spark, sf, "events").select("props").write.mode("overwrite").text(out)
    return R.read_json_lines(spark, out, schema="k bigint")


@query("scan_parquet_project", "SELECT l_orderkey, l_quantity FROM lineitem")
def q_scan_parquet_project(spark, sf):
    return R.read_parquet(spark, f"{sf}/lineitem.parquet", columns=["l_orderkey", "l_quantity", "not_there"])


@query("read_options_slice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def q_read_options_slice(spark, sf):
    return R.apply_read_options(table(spark, sf, "orders"), columns=["o_orderkey", "o_custkey", "o_totalprice", "nope"],
                                exclude_columns=["o_custkey"], skip_rows=100, row_limit=50, order_by=["o_orderkey"])


_CUST = [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"), ("c_acctbal", "float"),
         ("c_mktsegment", "string")]


@query("probe_schema", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {i} AS position, '{t}' AS inferred_type, count(*) FILTER (WHERE {c} IS NULL) > 0 AS nullable,
       count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(DISTINCT {c}) AS distinct_count, count(*) AS row_count,
       (SELECT string_agg(CAST({c} AS VARCHAR), '|' ORDER BY c_custkey)
        FROM (SELECT c_custkey, {c} FROM customer WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 10)) AS samples
FROM customer""" for i, (c, t) in enumerate(_CUST)))
def q_probe_schema(spark, sf):
    return probe_schema(table(spark, sf, "customer"), samples=10, order_by=["c_custkey"])


_TREE = {"or": [
    {"and": [{"field": "p_name", "operator": "contains", "value": "RING"},
             {"field": "p_size", "operator": "gt", "value": 20}]},
    {"not": [{"field": "p_brand", "operator": "startswith", "value": "brand#1"}]},
]}


@query("predicate_tree", """
SELECT * FROM part
WHERE (contains(lower(p_name), 'ring') AND p_size > 20) OR NOT starts_with(lower(p_brand), 'brand#1')
""")
def q_predicate_tree(spark, sf):
    return table(spark, sf, "part").filter(R.file_predicate(_TREE, {"p_name": "p_name", "p_size": "p_size",
                                                                    "p_brand": "p_brand"}))


@query("multi_file_union", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS total_price, o_orderdate,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders
""")
def q_multi_file_union(spark, sf):
    o = table(spark, sf, "orders")
    base = scratch_path(spark, "orders-split")
    paths = []
    for st in ("F", "O", "P"):
        part = o.filter(F.col("o_orderstatus") == st)
        if st == "P":
            part = part.drop("o_orderpriority")
        p = f"{base}/status={st}"
        part.write.mode("overwrite").parquet(p)
        paths.append(p)
    return R.read_many(spark, paths, "parquet", renames={"o_totalprice": "total_price"})


@query("sanitize_name", r"""
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name || '/' || p_brand || ':' || p_type || '?',
       '[<>:"/\\|?*]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS output_name
FROM part
""")
def q_sanitize_name(spark, sf):
    p = table(spark, sf, "part")
    raw = F.concat(F.col("p_name"), F.lit("/"), F.col("p_brand"), F.lit(":"), F.col("p_type"), F.lit("?"))
    return p.select("p_partkey", K.sanitize_name_col(raw).alias("output_name"))


@query("stable_row_id", """
SELECT c_custkey, substr(sha256('{"_seed":42,"c_custkey":' || c_custkey || ',"c_name":"' || c_name
                                || '","c_nationkey":' || c_nationkey || '}'), 1, 8) AS row_id
FROM customer
""")
def q_stable_row_id(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", K.row_id(["c_custkey", "c_name", "c_nationkey"]).alias("row_id"))


_SPARSE = [("o_orderkey", "integer", "o_orderkey"), ("late", "float", "CASE WHEN o_orderkey > 5000 THEN o_totalprice END"), ("never", "string", "NULL::VARCHAR")]


@query("probe_sparse", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {i} AS position, '{t}' AS inferred_type, count(*) > count({e}) AS nullable, count(*) - count({e}) AS null_count,
       count(DISTINCT {e}) AS distinct_count, count(*) AS row_count,
       (SELECT string_agg(v, '|' ORDER BY o_orderkey) FROM (SELECT o_orderkey, CAST({e} AS VARCHAR) AS v FROM orders WHERE {e} IS NOT NULL ORDER BY o_orderkey LIMIT 5)) AS samples
FROM orders""" for i, (c, t, e) in enumerate(_SPARSE)))
def q_probe_sparse(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") > 5000, F.col("o_totalprice")).alias("late"), F.lit(None).cast("string").alias("never"))
    return probe_schema(o, samples=5, order_by=["o_orderkey"])


@query("multi_file_csv", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS DOUBLE) AS o_custkey, o_orderstatus,
       CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS o_orderpriority FROM orders
""")
def q_multi_file_csv(spark, sf):
    # files with the same columns in another order, and files that lack some
    o, base = table(spark, sf, "orders"), scratch_path(spark, "orders-csv")
    columns = {"F": ["o_orderkey", "o_custkey", "o_orderstatus"], "O": ["o_orderpriority", "o_custkey", "o_orderstatus", "o_orderkey"], "P": ["o_orderstatus", "o_orderkey"]}
    for status, names in columns.items():
        o.where(F.col("o_orderstatus") == status).select(*names).write.option("header", True).csv(f"{base}/{status}")
    return R.read_many(spark, [f"{base}/{status}" for status in columns], "csv").select(
        "o_orderkey", F.col("o_custkey").cast("double").alias("o_custkey"), "o_orderstatus", "o_orderpriority")


@query("detect_heads", """
SELECT CAST(n_nationkey % 4 AS BIGINT) AS file_no, CASE n_nationkey % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN ';' ELSE '|' END AS delimiter,
       CASE WHEN n_nationkey % 4 = 3 THEN 'latin-1' ELSE 'utf-8' END AS encoding, CASE WHEN n_nationkey % 4 = 2 THEN 'jsonl' ELSE 'json' END AS kind
FROM nation GROUP BY ALL
""")
def q_detect_heads(spark, sf):
    """Delimiter, encoding and JSON kind of files from their heads alone."""
    nation = table(spark, sf, "nation")
    csv, enc, js = (scratch_path(spark, n) for n in ("heads-csv", "heads-enc", "heads-json"))
    for k, d in enumerate(R.DELIMITERS):
        part = nation.where(F.col("n_nationkey") % 4 == k).coalesce(1)
        part.write.option("header", True).option("sep", d).csv(f"{csv}/f={k}")
        name = F.concat(F.lit("caf\u00e9 "), "n_name")
        part.select(F.encode(name, "ISO-8859-1" if k == 3 else "UTF-8").alias("value")).select(F.decode("value", "ISO-8859-1").alias("value")).write.option("encoding", "ISO-8859-1").csv(f"{enc}/f={k}")
        rows = part.select("n_nationkey", "n_name")
        if k == 2:
            rows.write.json(f"{js}/f={k}")
        else:
            rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(f"{js}/f={k}")
    no = F.regexp_extract("file_path", r"/f=(\d)/", 1).cast("long").alias("file_no")
    files = lambda at, ext: [f"{at}/f={k}/*.{ext}" for k in range(4)]
    d = R.detect_delimiters(spark, files(csv, "csv")).select(no, "delimiter")
    e = R.detect_encodings(spark, files(enc, "csv")).select(no, "encoding")
    j = R.detect_json_kind(spark, [f"{js}/f={k}/part-*" for k in range(4)]).select(no, "kind")
    return d.join(e, "file_no").join(j, "file_no")


@query("dataset_roundtrip", """
SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 6) AS balance, (SELECT count(*) FROM customer) AS manifest_rows, 3::BIGINT AS manifest_columns FROM customer GROUP BY 1
""")
def q_dataset_roundtrip(spark, sf):
    """A dataset written with its manifest, found in the catalogue and read back (SNK-01, SRC-18)."""
    base = scratch_path(spark, "datasets")
    K.write_dataset(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), base, "customers", lineage=["raw"])
    rows, manifest = R.read_dataset(spark, base, "customers")
    told = manifest.join(R.list_datasets(spark, base).select("dataset_id"), "dataset_id").select(F.col("row_count").alias("manifest_rows"), F.size("columns").cast("long").alias("manifest_columns"), F.lit(1).alias("k"))
    out = rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 6).alias("balance")).withColumn("k", F.lit(1))
    return out.join(told, "k").drop("k")


@query("export_tables", """
SELECT 'nation' AS table_name, n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region
UNION ALL SELECT 'csv', n_nationkey, n_name FROM nation UNION ALL SELECT 'json', r_regionkey, r_name FROM region
""")
def q_export_tables(spark, sf):
    """Tables written one by one and together by table id, and exported as CSV and JSON (SNK-02, SNK-03)."""
    base = scratch_path(spark, "exports")
    tables = {n: table(spark, sf, n).select(F.col(f"{n[0]}_{n}key").cast("long").alias("id"), F.col(f"{n[0]}_name").alias("name")) for n in ("nation", "region")}
    K.write_tables(tables, base)
    both = spark.read.parquet(f"{base}/_combined").select(F.col("__table_id__").alias("table_name"), "id", "name")
    K.export(tables["nation"], f"{base}/csv", "csv")
    K.export(tables["region"], f"{base}/json", "json")
    csv = R.read_any(spark, f"{base}/csv/part-*.csv").select(F.lit("csv").alias("table_name"), F.col("id").cast("long").alias("id"), "name")
    return both.unionByName(csv).unionByName(R.read_json(spark, f"{base}/json/part-*.json").select(F.lit("json").alias("table_name"), "id", "name"))


@query("discover_files", """
SELECT r_name AS folder, 'csv' AS extension, true AS supported FROM region UNION ALL SELECT r_name, 'dat', false FROM region WHERE r_regionkey % 2 = 0
""")
def q_discover_files(spark, sf):
    """Files of a folder tree with their extensions, those that a reader knows marked (SRC-12, SRC-13)."""
    root = scratch_path(spark, "tree")
    region = table(spark, sf, "region")
    region.withColumn("folder", F.col("r_name")).write.partitionBy("folder").option("header", True).csv(f"{root}/a")
    region.where("r_regionkey % 2 = 0").select(F.col("r_name").alias("folder"), F.col("r_comment" if "r_comment" in region.columns else "r_name").alias("value")).write.partitionBy("folder").text(f"{root}/b")
    found = R.discover_files(spark, root, exclude=["_SUCCESS"]).where(F.col("extension").isin(".csv", ".txt"))
    return found.select(F.regexp_extract("path", "folder=(.*)$", 1).alias("folder"), F.when(F.col("extension") == ".txt", "dat").otherwise(F.substring("extension", 2, 9)).alias("extension"),
                        (F.col("supported") & (F.col("extension") == ".csv")).alias("supported"))


@query("table_availability", """
WITH f AS (SELECT o_orderkey::VARCHAR AS file_path, o_orderkey % 4 AS k FROM orders)
SELECT file_path, 'lines' AS table_id, CASE WHEN k = 0 THEN 'FAILED' WHEN k = 1 THEN 'PARTIAL' ELSE 'AVAILABLE' END AS status,
       CASE WHEN k = 1 THEN 'price' ELSE '' END AS missing, CASE WHEN k > 1 THEN 1 ELSE 0 END::BIGINT AS selected FROM f
""")
def q_table_availability(spark, sf):
    """Tables of many files: there, in part or not at all, and what is selected of them (SRC-15, SRC-16)."""
    from quarry.sources.probe import select_tables, table_availability

    o, k = table(spark, sf, "orders"), F.col("o_orderkey") % 4
    columns = F.when(k == 0, F.array(F.lit(None).cast("string"))).when(k == 1, F.array(F.lit("id"))).otherwise(F.array(F.lit("id"), F.lit("price")))
    tried = o.select(F.col("o_orderkey").cast("string").alias("file_path"), F.lit("lines").alias("table_id"), F.explode(columns).alias("column_name"))
    avail = table_availability(tried, {"lines": ["id", "price"]})
    chosen = select_tables(avail, ["lines"]).select("file_path", F.size("tables").cast("long").alias("selected"))
    return avail.join(chosen, "file_path", "left").select("file_path", "table_id", "status", F.array_join("missing_columns", ",").alias("missing"), F.coalesce("selected", F.lit(0)).cast("long").alias("selected"))
