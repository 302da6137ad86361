"""Structured Streaming jobs (STR-01..04).

The reference reads large files in row chunks and syncs a folder of documents;
here both are file-source streams:

* chunked ingest: ``readStream`` over a folder, bounded per trigger with
  ``maxFilesPerTrigger``; every micro-batch is one chunk.  ``foreachBatch``
  writes the batch idempotently into ``batch_id=<n>`` (overwrite of that
  partition only), so a restart after a failure re-writes the unfinished
  chunk instead of duplicating it, and records chunk metadata (rows, running
  total, last-chunk flag for ``availableNow`` runs).
* folder sync: new/changed documents -> parse -> hash-upsert into a snapshot
  table; within a batch only the newest version per id is kept (debounce).
* profile extraction as a stream: every strategy is stateless, so the same
  plan runs per micro-batch once columns come from the profile.

All state lives in the checkpoint location (a shared folder), so a lost
executor or a restarted driver resumes from the last committed batch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def chunked_ingest(spark: SparkSession, source_dir: str, schema: str, fmt: str, output_dir: str,
                   checkpoint_dir: str, files_per_trigger: int = 1, options: Mapping[str, Any] | None = None,
                   transform: Callable[[DataFrame], DataFrame] | None = None,
                   available_now: bool = True) -> StreamingQuery:
    """STR-01 / STR-03: stream a folder in chunks into ``output_dir/batch_id=<n>``
    and ``output_dir/_chunks`` (chunk index, rows, running total)."""
    rd = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    for k, v in (options or {}).items():
        rd = rd.option(k, v)
    stream = rd.load(source_dir)
    if transform is not None:
        stream = transform(stream)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("batch_id", F.lit(batch_id))
        # dynamic partition overwrite: re-running a batch replaces only its own partition
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("batch_id").parquet(output_dir)
        # row count from the written partition's metadata (no re-run of the batch plan)
        n = batch.sparkSession.read.parquet(f"{output_dir}/batch_id={batch_id}").count()
        meta = batch.sparkSession.createDataFrame([(batch_id, n)], "chunk_index long, rows long")
        meta.write.mode("overwrite").parquet(f"{output_dir}/_chunks/chunk={batch_id}")

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()


def chunk_summary(spark: SparkSession, output_dir: str) -> DataFrame:
    """Chunk metadata with running total and last-chunk flag."""
    from pyspark.sql import Window

    m = spark.read.parquet(f"{output_dir}/_chunks")
    w = Window.orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = m.agg(F.max("chunk_index").alias("__last")).withColumn("__k", F.lit(1))
    # chunk metadata has one row per micro-batch (small); the window orders those rows only
    return (m.withColumn("running_total", F.sum("rows").over(w)).withColumn("__k", F.lit(1))
            .join(last, "__k").withColumn("is_last", F.col("chunk_index") == F.col("__last"))
            .drop("__last", "__k"))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there; any other trouble with it is an error, not an absence."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# ---------------------------------------------------------------- a snapshot in versions
def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def snapshot_versions(spark: SparkSession, snapshot_dir: str) -> list[int]:
    """Committed versions, oldest first."""
    if not _exists(spark, f"{snapshot_dir}/commits"):
        return []
    fs, p = _fs(spark, f"{snapshot_dir}/commits")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit())


def _manifest(spark: SparkSession, snapshot_dir: str, version: int | None) -> dict[int, int]:
    """Which version of each bucket a version of the snapshot holds (a row a bucket)."""
    return {} if version is None else {r["bucket"]: r["version"] for r in spark.read.parquet(f"{snapshot_dir}/manifests/{version}").collect()}


def read_snapshot(spark: SparkSession, snapshot_dir: str, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """The last committed version (or the one given) of the snapshot, or some of its buckets; None where there is none.

    A version is a list of bucket folders that are never written again, so readers see it whole whatever is being merged."""
    known = snapshot_versions(spark, snapshot_dir)
    if not known:
        return None
    held = _manifest(spark, snapshot_dir, known[-1] if version is None else version)
    paths = [f"{snapshot_dir}/data/version={v}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
    if not paths:
        some = next(iter(held.items()))
        return spark.read.option("basePath", f"{snapshot_dir}/data").parquet(f"{snapshot_dir}/data/version={some[1]}/bucket={some[0]}").drop("version").limit(0)
    return spark.read.option("basePath", f"{snapshot_dir}/data").option("mergeSchema", True).parquet(*paths).drop("version")


def drop_old_versions(spark: SparkSession, snapshot_dir: str, keep: int = 1) -> int:
    """Delete bucket folders, manifests and marks of all but the last ``keep`` versions; returns how many versions went."""
    known = snapshot_versions(spark, snapshot_dir)
    old, kept = known[:-keep], known[-keep:]
    used = {(b, v) for k in kept for b, v in _manifest(spark, snapshot_dir, k).items()}
    for k in old:  # the mark goes first: a version is there as a whole or not at all
        fs, p = _fs(spark, f"{snapshot_dir}/commits/{k}")
        fs.delete(p, False)
    for k in old:
        for b, v in _manifest(spark, snapshot_dir, k).items():
            if (b, v) not in used:
                fs, p = _fs(spark, f"{snapshot_dir}/data/version={v}/bucket={b}")
                fs.delete(p, True)
        fs, p = _fs(spark, f"{snapshot_dir}/manifests/{k}")
        fs.delete(p, True)
    return len(old)


def merge_documents(spark: SparkSession, docs: DataFrame, snapshot_dir: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = 256) -> int | None:
    """Upsert ``docs`` (with source_file, source_time) into the snapshot by content hash; returns the version made.

    Of several versions of an id the one with the latest source time counts, the
    snapshot's own included: an older file that arrives later changes nothing.  The
    snapshot is dealt by a hash bucket of the id; only the buckets touched are
    read, and written under the new version; the others are taken over by the manifest.  The version counts from the
    moment its mark is made, the last and smallest step: a run that fails before leaves the old one whole, and
    its leftovers are overwritten by the next.  Two writers cannot make the same mark."""
    from quarry.operators.text import hash_upsert

    if docs.isEmpty():  # files without a row
        return None
    others = [c for c in docs.columns if c != id_col]
    newest = (docs.groupBy(id_col).agg(F.max_by(F.struct(*others), F.struct("source_time", "source_file")).alias("r")).select(id_col, "r.*")
              .withColumn("content_hash", F.substring(F.sha2(F.col(text_col), 256), 1, 16))
              .withColumn("archived_at", F.lit(None).cast("timestamp"))
              .withColumn("bucket", F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).cast("int")))
    known = snapshot_versions(spark, snapshot_dir)
    held = _manifest(spark, snapshot_dir, known[-1] if known else None)
    version = known[-1] + 1 if known else 1
    touched = [r[0] for r in newest.select("bucket").distinct().collect()]  # at most ``buckets``
    old = read_snapshot(spark, snapshot_dir, buckets=touched) if known else None
    if old is None:
        result = newest.withColumn("action", F.lit("inserted"))
    else:
        before = old.select(id_col, F.col("source_time").alias("__known"))
        newest = newest.join(before, id_col, "left").where("__known IS NULL OR source_time >= __known").drop("__known")
        acts = hash_upsert(old.select(id_col, "content_hash", "archived_at"), newest.select(id_col, "content_hash"), id_col).select(id_col, "action")
        result = newest.join(acts, id_col).unionByName(old.join(newest.select(id_col), id_col, "left_anti"), allowMissingColumns=True)
    data = f"{snapshot_dir}/data/version={version}"
    result.write.mode("overwrite").partitionBy("bucket").parquet(data)
    fs, p = _fs(spark, data)
    written = {int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if f.getPath().getName().startswith("bucket=")}
    manifest = {**{b: v for b, v in held.items() if b not in touched}, **dict.fromkeys(written, version)}
    spark.createDataFrame(sorted(manifest.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{snapshot_dir}/manifests/{version}")
    fs, p = _fs(spark, f"{snapshot_dir}/commits/{version}")
    fs.create(p, False).close()
    return version


def _with_source(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"source_file": F.col("_metadata.file_path"), "source_time": F.col("_metadata.file_modification_time")})


def _files_read(spark: SparkSession, snapshot_dir: str, checkpoint_dir: str | None) -> DataFrame:
    """(source_file, then): every file read so far and the latest time it had when it was read.

    The stream's own log of files in its checkpoint names all that it took, also those
    without a row or whose rows all lost to newer ones; files merged again after an
    edit are kept beside the snapshot; rows of the snapshot name their files too."""
    parts = [spark.createDataFrame([], "source_file string, then timestamp")]
    if checkpoint_dir and _exists(spark, f"{checkpoint_dir}/sources/0"):
        log = spark.read.schema("path string, timestamp long").json(f"{checkpoint_dir}/sources/0").where("path IS NOT NULL")  # the first line is a version
        parts.append(log.select(F.col("path").alias("source_file"), F.timestamp_millis("timestamp").alias("then")))
    if _exists(spark, f"{snapshot_dir}_files"):
        parts.append(spark.read.parquet(f"{snapshot_dir}_files"))
    held = read_snapshot(spark, snapshot_dir)
    if held is not None:
        parts.append(held.select("source_file", F.col("source_time").alias("then")))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(_plain("source_file").alias("source_file")).agg(F.max("then").alias("then"))


def _plain(path: str) -> Column:
    """One spelling of local paths: file:/x, file:///x."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def sync_edited(spark: SparkSession, docs_dir: str, snapshot_dir: str, schema: str | None = None, fmt: str = "json",
                checkpoint_dir: str | None = None, **kw) -> int:
    """Merge again the files that were changed after they were read; returns how many.

    The listing (paths and times, no contents) is compared with :func:`_files_read`;
    without the stream's ``checkpoint_dir`` files that left no row are not known there."""
    listed = spark.read.format("binaryFile").load(docs_dir).select("path", _plain("_metadata.file_path").alias("source_file"), F.col("modificationTime").alias("now"))
    edited = listed.join(_files_read(spark, snapshot_dir, checkpoint_dir), "source_file").where("now > then").select("path", "source_file", "now").collect()  # edited files only
    if edited:
        reader = spark.read.schema(schema) if schema else spark.read
        merge_documents(spark, _with_source(reader.format(fmt).load([r["path"] for r in edited])), snapshot_dir, **kw)
        spark.createDataFrame([(r["source_file"], r["now"]) for r in edited], "source_file string, then timestamp").coalesce(1).write.mode("append").parquet(f"{snapshot_dir}_files")
    return len(edited)


def folder_sync(spark: SparkSession, docs_dir: str, snapshot_dir: str, checkpoint_dir: str,
                id_col: str = "doc_id", text_col: str = "text", schema: str | None = None,
                fmt: str = "json", available_now: bool = True, snapshot_buckets: int = 256) -> StreamingQuery:
    """STR-02: keep a snapshot of a folder of documents, the newest version per id; :func:`read_snapshot` reads it.

    New files arrive as a stream.  The file source never reads a known path again,
    so files edited in place are found by :func:`sync_edited`, at the start and
    with every batch.  ``action`` records the last change applied to each row."""
    kw = {"id_col": id_col, "text_col": text_col, "buckets": snapshot_buckets}
    sync_edited(spark, docs_dir, snapshot_dir, schema, fmt, checkpoint_dir, **kw)
    rd = spark.readStream.format(fmt)
    if schema:
        rd = rd.schema(schema)

    def merge(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        merge_documents(s, batch, snapshot_dir, **kw)
        sync_edited(s, docs_dir, snapshot_dir, schema, fmt, checkpoint_dir, **kw)

    w = _with_source(rd.load(docs_dir)).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="500 milliseconds")
    return w.start()


def stream_extract(spark: SparkSession, source_dir: str, tables: Sequence[Mapping[str, Any]], output_dir: str,
                   checkpoint_dir: str, files_per_trigger: int = 10) -> StreamingQuery:
    """STR-04: whole JSON files as a stream -> VARIANT -> every profile table per
    micro-batch (discovery runs on the batch, which is bounded by the trigger).

    Files that do not parse are kept in ``_bad_files`` and tables whose configuration
    failed in ``_warnings``, both by batch, as the batch form returns them."""
    from quarry.operators.extract import extract_tables

    stream = (spark.readStream.format("text").option("wholetext", True)
              .option("maxFilesPerTrigger", files_per_trigger).load(source_dir)
              .select(F.col("_metadata.file_path").alias("file_path"), F.try_parse_json("value").alias("doc")))

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by the discovery and by each table
        out, warnings = extract_tables(batch.filter(F.col("doc").isNotNull()), tables)
        bad = batch.filter(F.col("doc").isNull()).select("file_path", F.lit("invalid JSON").alias("reason"))
        told = batch.sparkSession.createDataFrame([(w["table_id"], w["message"]) for w in warnings], "table_id string, message string")
        for name, df in {**out, "_bad_files": bad, "_warnings": told}.items():
            df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
                .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{output_dir}/{name}")
        batch.unpersist()

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())
