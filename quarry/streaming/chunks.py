"""Large files in chunks of rows, as a stream (STR-01, STR-03).

1. Plan: tasks count row ends in byte blocks of the files (both for an even and an odd number
   of quotes before the block, so quoted line breaks are no row ends); running sums over a file's blocks turn
   these into row numbers; only blocks in which a chunk begins are read once more, for its byte.
2. The plan is written as one small file a micro-batch, of one chunk or, for many chunks, several.  Spark's file source
   streams that folder, a file a trigger, so admission, progress and restart are Spark's own.
3. A batch's tasks, one a chunk, read their chunk's byte range and parse its rows in the JVM; output goes to a partition of
   the chunk, overwritten as a whole, so a restart redoes the open batch's chunks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.sources.heads import listed, open_path

#: Rows of a chunk, and of one of a file beyond ``LARGE_FILE`` bytes.
CHUNK_ROWS, LARGE_CHUNK_ROWS, LARGE_FILE = 50_000, 100_000, 1 << 30
BLOCK_BYTES = 8 * 1024 * 1024
#: Micro-batches of a stream at most, if nothing else is asked for: what a batch costs besides its chunks does not grow with the files.
BATCHES = 64
_PLAN = "file_path string, chunk_index long, first_row long, rows long, start long, end long, running_total long, is_last boolean"


def _row_ends(data: bytes, before: bytes, quote: int | None, odd: bool) -> np.ndarray:
    """Places of the line feeds that end a row which is not blank; ``before`` is up to two bytes that precede ``data``."""
    a = np.frombuffer(before + data, np.uint8)
    ends = a == 10
    if quote is not None:
        q = np.cumsum(a[len(before):] == quote) & 1
        ends[len(before):] &= q == (1 if odd else 0)
    previous = np.concatenate([[10], a[:-1]])
    second = np.concatenate([[10, 10], a[:-2]])[:len(a)]
    blank = (previous == 10) | ((previous == 13) & (second == 10))
    return np.flatnonzero((ends & ~blank)[len(before):])


def _read(fs, name: str, start: int, n: int) -> tuple[bytes, bytes]:
    """(up to two bytes before, the range)."""
    with fs.open_input_file(name) as f:
        back = min(2, start)
        f.seek(start - back)
        data = f.read(n + back)
    return data[:back], data[back:]


def plan_chunks(spark: SparkSession, paths: str | Sequence[str], rows: int | None = None, header: bool = True, quote: str | None = '"', block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Byte ranges of the chunks of each file: file_path, chunk_index, first_row, rows, start, end, running_total, is_last.

    ``rows`` a chunk (``CHUNK_ROWS``, or ``LARGE_CHUNK_ROWS`` for files beyond ``LARGE_FILE``).  A row ends
    with a line feed outside quotes (``quote`` None: any), the last one also with the file; blank lines are no rows; with
    ``header`` a file's first row is not counted.  A file without rows has no chunk."""
    mark, lead = ord(quote) if quote else None, int(header)
    size = F.lit(rows) if rows else F.when(F.col("length") > LARGE_FILE, LARGE_CHUNK_ROWS).otherwise(CHUNK_ROWS)
    files = listed(spark, paths).withColumn("size", size.cast("long"))
    blocks = files.select("file_path", "length", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block_bytes))).alias("block"))
    # a file's blocks are spread over the tasks
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_path", "block")

    def count(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found = []
            for path, length, _, block in zip(*(c.to_pylist() for c in b.columns)):
                before, data = _read(*open_path(path), block * block_bytes, min(block_bytes, length - block * block_bytes))
                even, odd = (len(_row_ends(data, before, mark, o)) for o in (False, True))
                tail = data.rstrip(b"\r\n")
                found.append((even, odd if mark else even, data.count(quote.encode()) if quote else 0, bool(tail) and not data.endswith(b"\n")))
            cols = [pa.array(c) for c in zip(*found)] if found else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "even", "odd", "quotes", "open"])

    stats = blocks.mapInArrow(count, "file_path string, length long, size long, block long, even long, odd long, quotes long, open boolean")
    # a file's blocks in order: a row a block, not a row a line
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_path")
    placed = stats.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1).withColumn("n", F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even")))
    placed = placed.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "ended": F.sum("n").over(whole), "unended": F.max(F.when((F.col("block") + 1) * block_bytes >= F.col("length"), F.col("open"))).over(whole)})
    placed = placed.withColumn("total", F.greatest(F.col("ended") + F.col("unended").cast("long") - lead, F.lit(0)))
    # chunk c begins behind row end number lead + c * size (the first chunk of a file without a header: at its start)
    first = F.ceil((F.greatest(F.col("before") + 1, F.lit(lead)) - lead) / F.col("size"))
    last = F.floor((F.least(F.col("before") + F.col("n"), F.col("total") + lead - 1) - lead) / F.col("size"))
    holding = placed.where((F.col("total") > 0) & (last >= first)).select("file_path", "length", "block", "inside", "before", "size", "total", first.alias("first"), last.alias("last"))
    holding = holding.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_path", "block")  # the windows left a file's blocks in one task

    def locate(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = []
            for path, length, block, inside, before, size_, total, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                ahead, data = _read(*open_path(path), block * block_bytes, min(block_bytes, length - block * block_bytes))
                ends = _row_ends(data, ahead, mark, inside)
                for c in range(lo, hi + 1):
                    nth = lead + c * size_ - before  # the chunk begins behind the nth row end of this block
                    if nth > 0:
                        out.append((path, length, size_, total, c, block * block_bytes + int(ends[nth - 1]) + 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["file_path", "length", "size", "total", "chunk_index", "start"])

    starts = holding.mapInArrow(locate, "file_path string, length long, size long, total long, chunk_index long, start long")
    if not header:
        starts = starts.unionByName(placed.where((F.col("block") == 0) & (F.col("total") > 0)).select("file_path", "length", "size", "total", F.lit(0).cast("long").alias("chunk_index"), F.lit(0).cast("long").alias("start")))
    following = F.lead("start").over(Window.partitionBy("file_path").orderBy("chunk_index"))
    first_row = F.col("chunk_index") * F.col("size")
    last_chunk = F.col("chunk_index") == F.floor((F.col("total") - 1) / F.col("size"))
    n = F.least(F.col("size"), F.col("total") - first_row)
    return starts.select("file_path", "chunk_index", first_row.alias("first_row"), n.alias("rows"), "start", F.coalesce(following, F.col("length")).alias("end"),
                         (first_row + n).alias("running_total"), last_chunk.alias("is_last"))


def read_ranges(chunks: DataFrame, quote: str | None = '"') -> DataFrame:
    """The rows of chunks (file_path, chunk_index, start, end), one task's worth each: file_path, chunk_index, row (from 0), value (the row's text)."""
    mark = ord(quote) if quote else None

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for path, chunk, start, end in zip(*(c.to_pylist() for c in b.columns)):
                before, data = _read(*open_path(path), start, end - start)
                at, values = 0, []
                for stop in [*(_row_ends(data, before or b"\n", mark, False) + 1).tolist(), len(data)]:
                    if text := data[at:stop].strip(b"\r\n"):
                        values.append(text)
                    at = stop
                for lo in range(0, len(values), 10_000):
                    part = values[lo:lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([chunk] * len(part), pa.int64()), pa.array(range(lo, lo + len(part)), pa.int64()),
                                                      pa.array([v.decode("utf-8", "replace") for v in part])], names=["file_path", "chunk_index", "row", "value"])

    return chunks.select("file_path", "chunk_index", "start", "end").mapInArrow(run, "file_path string, chunk_index long, row long, value string")


def parse_rows(rows: DataFrame, schema: str, fmt: str = "csv", options: Mapping[str, Any] | None = None) -> DataFrame:
    """``value`` parsed by the JVM's CSV or JSON parser; a bad row becomes nulls."""
    parse = {"csv": F.from_csv, "json": F.from_json}[fmt]
    return rows.withColumn("__r", parse("value", schema, {k: str(v) for k, v in (options or {}).items()})).select("file_path", "chunk_index", "row", "__r.*")


def ingest_chunks(spark: SparkSession, paths: str | Sequence[str], schema: str, output_dir: str, checkpoint_dir: str, rows: int | None = None, fmt: str = "csv",
                  header: bool = True, options: Mapping[str, Any] | None = None, transform: Callable[[DataFrame], DataFrame] | None = None,
                  chunks_per_trigger: int | None = None, block_bytes: int = BLOCK_BYTES) -> StreamingQuery:
    """Stream large files chunk by chunk into ``output_dir/chunk=<n>``, and what each chunk held into ``output_dir``\\ ``_chunks``.

    ``chunks_per_trigger`` chunks are a micro-batch; by default one, or of many chunks as many as keep the stream to ``BATCHES``
    micro-batches.  The plan is made once and kept under ``checkpoint_dir``, so a restart goes on with the
    same chunks and micro-batches.  JSON is JSON Lines.  ``transform`` sees a batch's rows with file_path, chunk_index and row."""
    quote = '"' if fmt == "csv" else None
    plan_dir = f"{checkpoint_dir}/plan"
    from quarry.streaming.streams import _exists

    if not _exists(spark, f"{plan_dir}/_SUCCESS"):
        plan = plan_chunks(spark, paths, rows, header and fmt == "csv", quote, block_bytes)
        number = F.row_number().over(Window.orderBy("file_path", "chunk_index")) - 1  # a row a chunk
        per = F.lit(chunks_per_trigger) if chunks_per_trigger else F.ceil(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) / BATCHES)
        plan.withColumns({"chunk": number.cast("long"), "per": per}).withColumn("n", F.floor(F.col("chunk") / F.col("per"))).drop("per") \
            .write.mode("overwrite").partitionBy("n").json(plan_dir)
    stream = spark.readStream.schema(_PLAN + ", chunk long").option("maxFilesPerTrigger", 1).json(f"{plan_dir}/n=*")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        batch = held.repartitionByRange(max(1, held.count()), "chunk").persist()  # a task a chunk
        out = parse_rows(read_ranges(batch, quote), schema, fmt, options)
        out = (transform(out) if transform else out).join(F.broadcast(batch.select("file_path", "chunk_index", "chunk")), ["file_path", "chunk_index"])
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(output_dir)
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{output_dir}_chunks")
        batch.unpersist()
        held.unpersist()

    return stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{checkpoint_dir}/stream").trigger(availableNow=True).start()
