"""Registered queries for extraction strategies and context columns (EXT, CTX).

Documents are built from the driver's tables with ``to_json`` (one document
per order / conversation / small block of orders), parsed to VARIANT and
extracted back; the oracle is the plain table.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

_KEEP = StorageLevel.MEMORY_AND_DISK

from quarry.operators import context as C
from quarry.operators import extract as E
from quarry.plans.registry import query, table


@query("json_flat_object", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_flat_object(spark, sf):
    docs = table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    return E.flat_object(docs, "$", keep=["event_id"])


def _order_blocks(spark, sf):
    o = table(spark, sf, "orders")
    row = F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_custkey").cast("string"),
                   F.lit(","), F.col("o_totalprice").cast("string"), F.lit(","), F.to_json(F.array("o_orderstatus"))
                   .substr(F.lit(2), F.length(F.to_json(F.array("o_orderstatus"))) - 2), F.lit("]"))
    blocks = o.groupBy(F.floor(F.col("o_orderkey") / 10).alias("file_path")).agg(
        F.concat(F.lit('{"columns":["o_orderkey","o_custkey","o_totalprice","o_orderstatus"],"values":['),
                 F.array_join(F.collect_list(row), ","), F.lit("]}")).alias("text"))
    # documents are read by the discovery pass and the extraction: keep them
    return blocks.select("file_path", F.try_parse_json("text").alias("doc")).persist(_KEEP)


@query("json_headers_data", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def q_json_headers_data(spark, sf):
    return E.headers_data(_order_blocks(spark, sf), "$").drop("file_path")


@query("json_array_of_objects", "SELECT conv_id, role, text, turn FROM conversations")
def q_json_array_of_objects(spark, sf):
    c = table(spark, sf, "conversations")
    docs = c.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.struct("turn", "role", "text"))
                                                         .alias("turns"))).alias("t")) \
        .select("conv_id", F.try_parse_json("t").alias("doc"))
    return E.array_of_objects(docs, "$.turns[*]", keep=["conv_id"])


@query("json_repeat_over", """
SELECT l_orderkey AS o_orderkey, l_quantity, l_extendedprice, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem
""")
def q_json_repeat_over(spark, sf):
    li = table(spark, sf, "lineitem")
    line = F.struct("l_linenumber", F.struct(
        F.array(F.lit("l_quantity"), F.lit("l_extendedprice")).alias("columns"),
        F.array(F.array("l_quantity", "l_extendedprice")).alias("values")).alias("measure"))
    # one VARIANT document per order, built straight from the struct
    docs = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.to_variant_object(F.struct(F.collect_list(line).alias("lines"))).alias("doc")).persist(_KEEP)
    return E.extract_with(docs, {"strategy": "headers_data", "path": "{line}.measure",
                                 "repeat_over": {"path": "$.lines", "as": "line",
                                                 "inject_fields": {"l_linenumber": "{line}.l_linenumber"}}},
                          keep=["o_orderkey"])


@query("unpivot", """
SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem
""")
def q_unpivot(spark, sf):
    li = table(spark, sf, "lineitem")
    return E.unpivot_table(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax", "absent"])


@query("json_doc_join", """
SELECT o.o_orderkey, o.o_totalprice, CAST(l.l_linenumber AS DOUBLE) AS l_linenumber, l.l_quantity
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
""")
def q_json_doc_join(spark, sf):
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))
                                         .alias("lines"))
    docs = (o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("file_path"),
                    F.to_variant_object(F.struct(F.array(F.struct("o_orderkey", "o_totalprice")).alias("order"),
                                                 F.coalesce("lines", F.array()).alias("lines"))).alias("doc")))
    docs = docs.persist(_KEEP)
    out = E.doc_join(docs, {"path": "$.order[*]", "key": "o_orderkey"}, {"path": "$.lines[*]", "key": "l_orderkey"},
                     "left")
    return out.select("o_orderkey", "o_totalprice", F.col("l_linenumber").cast("double").alias("l_linenumber"),
                      "l_quantity")


@query("context_priority", r"""
SELECT c_name AS file_path, nullif(regexp_extract(c_name, 'Customer#0*(\d+)', 1), '') AS customer_no,
       coalesce(CASE WHEN c_nationkey < 5 THEN c_mktsegment END, 'UNKNOWN') AS segment,
       'EU' AS region, 'T1' AS tool
FROM customer
""")
def q_context_priority(spark, sf):
    c = table(spark, sf, "customer")
    docs = c.select(F.col("c_name").alias("file_path"), F.try_parse_json(F.to_json(F.struct(F.struct(
        F.when(F.col("c_nationkey") < 5, F.col("c_mktsegment")).alias("segment")).alias("meta")))).alias("doc"))
    fields = {
        "customer_no": {"regex": {"pattern": r"Customer#0*(?P<customer_no>\d+)", "group": "customer_no",
                                  "scope": "filename"}},
        "segment": {"json_path": "$.meta.segment", "default": "UNKNOWN"},
        "region": {"default": "NA"},
        "tool": {"default": "T1"},
    }
    return C.file_context(docs, fields, overrides={"region": "EU", "tool": "T9"}, allowed_overrides=["region"])


@query("regex_capture", "SELECT p_partkey, lower(nullif(regexp_extract(p_type, '^([A-Z]{3})', 1), '')) AS kind FROM part")
def q_regex_capture(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", C.regex_capture(F.col("p_type"), r"^(?P<kind>[A-Z]{3})", "kind", "lower").alias("kind"))


@query("attach_context", """
SELECT l.l_orderkey AS key, l.l_linenumber, l.l_quantity, l.l_returnflag AS o_orderstatus, o.o_custkey
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
""")
def q_attach_context(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_quantity",
                                             F.col("l_returnflag").alias("o_orderstatus"))
    ctx = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", "o_orderstatus",
                                            "o_orderpriority")
    return C.attach_context(li, ctx, "key", keys=["o_custkey", "o_orderstatus"])


@query("attach_keyed_context", """
WITH ctx AS (SELECT user_id, arg_min(event_type, event_id) AS first_event_type, count(*) AS n_events
             FROM events GROUP BY user_id)
SELECT e.event_id, e.user_id, e.value, ctx.first_event_type, ctx.n_events
FROM events e LEFT JOIN ctx USING (user_id)
""")
def q_attach_keyed_context(spark, sf):
    e = table(spark, sf, "events")
    ctx = e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_event_type"),
                                   F.count(F.lit(1)).alias("n_events"))
    return C.attach_context(e.select("event_id", "user_id", "value"), ctx, "user_id")


@query("json_headers_mixed", """
SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN o_orderstatus END AS p,
       CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS DOUBLE) END AS "it's" FROM orders
""")
def q_json_headers_mixed(spark, sf):
    # three header sets; one name with numbers and texts, one with a quote, and rows that are bare scalars
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = (F.when(F.col("o_orderkey") % 3 == 0, F.format_string('{"columns": ["k", "p"], "values": [[%s, %s]]}', k, c))
            .when(F.col("o_orderkey") % 3 == 1, F.format_string("""{"columns": ["k", "p", "it's"], "values": [{"it's": %s, "k": %s, "p": "%s"}]}""", c, k, F.col("o_orderstatus")))
            .otherwise(F.format_string('{"columns": ["k"], "values": [%s]}', k)))
    out = E.headers_data(o.select(F.try_parse_json(text).alias("doc")), "$", keep=[])
    return out.withColumn("it's", F.col("it's").cast("double"))


@query("json_doc_join_empty", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS s FROM orders WHERE o_orderkey % 3 > 0
""")
def q_json_doc_join_empty(spark, sf):
    # documents whose right array is empty (odd keys) or absent (every third): left rows, or none
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    right = F.when(k % 2 == 0, F.format_string(', "r": [{"id": %s, "s": "%s"}]', k.cast("string"), F.col("o_orderstatus"))).otherwise(F.lit(', "r": []'))
    text = F.concat(F.format_string('{"l": [{"k": %s}]', k.cast("string")), F.when(k % 3 > 0, right).otherwise(F.lit("")), F.lit("}"))
    docs = o.select(k.alias("file_path"), F.try_parse_json(text).alias("doc"))
    return E.doc_join(docs, {"path": "$.l[*]", "key": "k"}, {"path": "$.r[*]", "key": "id"}, "left").select("k", "s")


@query("flagship", """
WITH g AS (SELECT * FROM lineitem WHERE l_quantity >= 1 AND l_discount BETWEEN 0.0 AND 0.1 AND l_extendedprice > 0),
t AS (SELECT count(*) AS n, avg(l_quantity) AS m FROM g),
c AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM g GROUP BY 1),
f AS (SELECT (sum(c.n * (c.m - t.m) * (c.m - t.m)) / (count(*) - 1)) / (sum(c.n * c.v) / (max(t.n) - count(*))) AS f, max(t.n) - count(*) AS d2 FROM c, t)
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum, round(avg(l_extendedprice), 6) AS l_extendedprice_mean, round(avg(l_discount), 6) AS l_discount_mean,
       round(max(f.f), 6) AS f_returnflag, round(exp(-max(d2) / 2.0 * ln(1 + 2 * max(f.f) / max(d2))), 9) AS p_returnflag
FROM g, f GROUP BY 1, 2
""")
def q_flagship(spark, sf):
    from quarry.plans.flagship import flagship

    out = flagship(spark, sf)
    return out.withColumns({c: F.round(c, 9 if c == "p_returnflag" else 6) for c in ("l_extendedprice_mean", "l_discount_mean", "f_returnflag", "p_returnflag")})


@query("json_case_keys", """
SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS id_2, n_name AS name, upper(n_name) AS name_2 FROM nation
""")
def q_json_case_keys(spark, sf):
    """Keys that differ only in case: each is a column that later steps can name."""
    text = F.format_string('{"ID": %d, "Id": %d, "NAME": "%s", "name": "%s"}', F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_name"), F.upper("n_name"))
    docs = table(spark, sf, "nation").select(F.col("n_name").alias("file_path"), F.try_parse_json(text).alias("doc"))
    return E.flat_object(docs).select(F.col("ID").alias("id"), F.col("Id_2").alias("id_2"), F.col("NAME").alias("name"), F.col("name_2").alias("name_2"))


def _customer_docs(spark, sf):
    c = table(spark, sf, "customer")
    # the second image is named by its metadata alone; to_json leaves nulls out
    image = lambda own, name, balance: F.struct(own.cast("string").alias("image_id"), F.struct(name.cast("string").alias("image_name"), balance.cast("double").alias("balance")).alias("metadata"))
    no, none = F.col("c_custkey").cast("string"), F.lit(None)
    text = F.to_json(F.struct(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("meta"), F.array(
        image(F.concat(F.lit("a"), no), none, F.col("c_acctbal")), image(none, F.concat(F.lit("b"), no), none)).alias("images")))
    path = F.when(F.col("c_custkey") % 5 == 0, F.lit("/x/none.json")).otherwise(F.format_string("/x/LOT%d_a.json", "c_custkey"))
    return c.select(F.concat(path, F.lit("?"), F.col("c_custkey").cast("string")).alias("file_path"), F.try_parse_json(text).alias("doc"))


@query("required_context", """
SELECT c_custkey AS no, CASE WHEN c_custkey % 5 = 0 THEN 'skipped' ELSE 'kept' END AS fate FROM customer
""")
def q_required_context(spark, sf):
    """Files whose name lacks a required field are told and left out (CTX-03)."""
    from quarry.operators import context as CT

    ctx = CT.file_context(_customer_docs(spark, sf), {"lot": {"regex": {"pattern": r"(?P<lot>LOT\d+)_", "group": "lot", "scope": "filename"}}})
    kept, told = CT.required_pattern_policy(ctx, ["lot"], "skip_file")
    no = F.substring_index("file_path", "?", -1).cast("long").alias("no")
    return kept.select(no, F.lit("kept").alias("fate")).unionByName(told.select(no, F.lit("skipped").alias("fate")))


@query("run_and_image_context", """
SELECT c_custkey AS no, c_mktsegment AS segment, 'a' || c_custkey AS image_id, c_acctbal AS balance FROM customer
UNION ALL SELECT c_custkey, c_mktsegment, 'b' || c_custkey, NULL FROM customer
""")
def q_run_and_image_context(spark, sf):
    """Context of a file and of each of its images (CTX-04, CTX-05)."""
    from quarry.operators import context as CT

    docs = _customer_docs(spark, sf)
    images = CT.image_context(docs, {"balance": "$.balance"})
    out = CT.attach_context(images, CT.run_context(docs, {"segment": "$.meta.segment"}))
    return out.select(F.substring_index("file_path", "?", -1).cast("long").alias("no"), "segment", "image_id", F.col("balance").cast("double").alias("balance"))


@query("config_errors", """
SELECT CASE WHEN p_size % 3 = 0 THEN 'no path' WHEN p_size % 3 = 1 THEN 'unknown' ELSE 'good' END AS kind, count(*) AS n FROM part GROUP BY 1
""")
def q_config_errors(spark, sf):
    """Table configurations held in a column, each checked (EXT-08); few distinct ones, counted by their rows."""
    import json

    kinds = {0: {"strategy": "array_of_objects"}, 1: {"strategy": "magic"}, 2: {"strategy": "flat_object", "path": "$"}}
    told = {json.dumps(c): "good" if not (e := E.validate_config(c)) else "no path" if "path" in e[0] else "unknown" for c in kinds.values()}
    rows = table(spark, sf, "part").select(F.element_at(F.array(*[F.lit(json.dumps(kinds[k])) for k in range(3)]), (F.col("p_size") % 3 + 1).cast("int")).alias("config"))
    names = F.create_map(*[F.lit(x) for kv in told.items() for x in kv])
    return rows.select(F.element_at(names, F.col("config")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
