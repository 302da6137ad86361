"""Registered streaming query: the stream's output must equal the batch table.

The driver's table is written as several files under the shared checkpoint
folder, streamed one file per trigger into idempotent ``batch_id`` partitions
(``availableNow``), and the written output is read back.
"""

from __future__ import annotations

from quarry.plans.registry import query, table
from quarry.session import scratch_path
from quarry.sources.sinks import drop_folder, join_files
from quarry.streaming.chunks import ingest_chunks
from quarry.streaming.streams import chunked_ingest

_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]


@query("stream_ingest", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def q_stream_ingest(spark, sf):
    src, out, ck = (scratch_path(spark, n) for n in ("stream-src", "stream-out", "stream-ckpt"))
    li = table(spark, sf, "lineitem").select(*_COLS)
    li.repartition(4).write.mode("overwrite").parquet(src)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in li.schema.fields)
    run = chunked_ingest(spark, src, schema, "parquet", out, ck, files_per_trigger=1)
    run.awaitTermination()
    if run.exception() is not None:
        raise RuntimeError(str(run.exception()))
    return spark.read.parquet(out).drop("batch_id")


@query("stream_extract", """
SELECT CAST(c_nationkey AS DOUBLE) AS nation, CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, c_acctbal, 'rows' AS kind FROM customer
UNION ALL SELECT NULL, NULL, NULL, NULL, 'bad'
""")
def q_stream_extract(spark, sf):
    from pyspark.sql import functions as F

    from quarry.streaming.streams import stream_extract

    src, out, ck = (scratch_path(spark, n) for n in ("extract-src", "extract-out", "extract-ckpt"))
    docs = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal", F.col("c_nationkey").alias("nation"))).alias("rows"))
    docs.write.partitionBy("c_nationkey").json(src)
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(f"{src}/c_nationkey=-1")
    run = stream_extract(spark, src, [{"id": "rows", "select": {"strategy": "array_of_objects", "path": "$.rows[*]"}}], out, ck, files_per_trigger=10)
    run.awaitTermination()
    if run.exception() is not None:
        raise RuntimeError(str(run.exception()))
    rows = spark.read.parquet(f"{out}/rows").select(F.col("nation").cast("double"), F.col("c_custkey").cast("double"), "c_name", "c_acctbal", F.lit("rows").alias("kind"))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[:-1]]
    return rows.unionByName(spark.read.parquet(f"{out}/_bad_files").select(*none, F.lit("bad").alias("kind")))


@query("stream_chunks", """
SELECT i // 20000 AS chunk_index, count(*) AS rows, max(i) + 1 AS running_total, i // 20000 = max(n) // 20000 AS is_last,
       CAST(sum(l_quantity) AS BIGINT) AS quantity, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order
FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER () - 1 AS n FROM lineitem)
GROUP BY i // 20000, n
""")
def q_stream_chunks(spark, sf):
    """One large CSV file in chunks of 20,000 rows: what each chunk held, from its rows and from the plan."""
    from pyspark.sql import functions as F

    src, out, ck = (scratch_path(spark, n) for n in ("chunk-src", "chunk-out", "chunk-ckpt"))
    li = table(spark, sf, "lineitem").select(*_COLS).orderBy("l_orderkey", "l_linenumber")
    li.write.csv(f"{src}-parts")
    join_files(spark, f"{src}-parts", f"{src}/lineitem.csv", ",".join(_COLS).encode() + b"\n")
    drop_folder(spark, f"{src}-parts")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in li.schema.fields)
    run = ingest_chunks(spark, f"{src}/*.csv", schema, out, ck, rows=20_000, block_bytes=1 << 20)
    run.awaitTermination()
    if run.exception() is not None:
        raise RuntimeError(str(run.exception()))
    held = spark.read.parquet(out).groupBy("chunk").agg(F.count("*").alias("rows"), F.sum("l_quantity").cast("long").alias("quantity"),
                                                       F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order"))
    return spark.read.parquet(f"{out}_chunks").drop("rows").join(held, "chunk").select("chunk_index", "rows", "running_total", "is_last", "quantity", "first_order", "last_order")


@query("folder_sync", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' ELSE 'old ' END || lang AS text, CASE WHEN doc_id % 3 = 0 THEN 'updated' ELSE 'inserted' END AS action FROM documents
""")
def q_folder_sync(spark, sf):
    """Documents written as files, synced, a third of them changed by later files, synced again; the snapshot's rows."""
    from pyspark.sql import functions as F

    from quarry.streaming.streams import folder_sync, read_snapshot

    src, snap, ck = (scratch_path(spark, n) for n in ("sync-src", "sync-snap", "sync-ckpt"))
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("old "), "lang").alias("text"))
    for rows in (docs, docs.where("doc_id % 3 = 0").withColumn("text", F.replace("text", F.lit("old "), F.lit("new ")))):
        rows.repartition(2).write.mode("append").json(src)
        run = folder_sync(spark, src, snap, ck, schema="doc_id long, text string", snapshot_buckets=16)
        run.awaitTermination()
        if run.exception() is not None:
            raise RuntimeError(str(run.exception()))
    return read_snapshot(spark, snap).select("doc_id", "text", "action")
