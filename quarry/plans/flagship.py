"""Flagship query: scan -> extract -> filter -> validate -> aggregate -> ANOVA.

Nested order documents are built from ``orders`` + ``lineitem`` (one JSON
document per order, lines as header/row blocks), extracted back with the
``repeat_over`` + ``headers_data`` strategies, filtered with row filters,
quarantined by value rules, aggregated per (return flag, line status) and
analysed with a one-way ANOVA of quantity by return flag.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import aggregates as A
from quarry.operators import extract as E
from quarry.operators import filters as FL
from quarry.operators import quality as Q
from quarry.operators import stats as ST


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = F.struct("l_linenumber", "l_returnflag", "l_linestatus", F.struct(
        F.array(F.lit("l_quantity"), F.lit("l_extendedprice"), F.lit("l_discount")).alias("columns"),
        F.array(F.array("l_quantity", "l_extendedprice", "l_discount")).alias("values")).alias("measure"))
    lines = li.groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    # the struct becomes a VARIANT document directly (no JSON text round trip)
    docs = o.join(lines, o.o_orderkey == lines.l_orderkey, "inner").select(
        F.col("o_orderkey").cast("string").alias("file_path"),
        F.to_variant_object(F.struct(
            F.struct("o_orderkey", "o_orderstatus", "o_orderpriority").alias("meta"), "lines")).alias("doc"))
    return docs


def extracted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents are read by the discovery passes and by the extraction itself:
    # keep them (memory, spilling to disk; recomputed from lineage if an executor is lost)
    docs = order_documents(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return E.extract_with(docs, {
        "strategy": "headers_data", "path": "{line}.measure",
        "repeat_over": {"path": "$.lines", "as": "line",
                        "inject_fields": {"l_linenumber": "{line}.l_linenumber",
                                          "l_returnflag": "{line}.l_returnflag",
                                          "l_linestatus": "{line}.l_linestatus"}}})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = extracted_lines(spark, sf_dir)
    kept = FL.apply_row_filters(lines, [{"column": "l_quantity", "op": "gte", "value": 1},
                                        {"column": "l_discount", "op": "between", "min": 0.0, "max": 0.1}])
    good, _bad = Q.quarantine_split(kept, {"price_positive": "l_extendedprice > 0"})
    # the extracted rows feed two aggregates (group-by and ANOVA cells): extract once
    good = good.persist(StorageLevel.MEMORY_AND_DISK)
    agg = A.config_groupby(good, ["l_returnflag", "l_linestatus"],
                           {"l_quantity": "sum", "l_extendedprice": "mean", "l_discount": "mean"})
    anova = ST.anova(good, ["l_returnflag"], "l_quantity").filter(F.col("source") == "l_returnflag") \
        .select(F.col("f").alias("f_returnflag"), F.col("p_value").alias("p_returnflag"))
    # the ANOVA summary is a single row: attached to every group on a constant key
    return agg.withColumn("__k", F.lit(1)).join(anova.withColumn("__k", F.lit(1)), "__k").drop("__k")
