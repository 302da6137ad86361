"""Parts of files: heads and byte ranges, read by tasks without passing whole files.

Files are listed by Spark (paths and lengths, no contents) and dealt to tasks, which open
them through Arrow's file systems (local and mounted folders, s3, gs, hdfs) and read only the
bytes asked for.  A scheme that Arrow cannot open is told by :func:`can_open`; the callers
then scan with Spark's own sources.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 65_536
_ENDS = re.compile(rb"\r\n|\n|\r")


def open_path(uri: str) -> tuple[pafs.FileSystem, str]:
    local = re.match(r"(?:file:)?(/.*)", uri)
    return (pafs.LocalFileSystem(), re.sub("^/+", "/", local[1])) if local else pafs.FileSystem.from_uri(uri)


def can_open(paths: str | Sequence[str]) -> bool:
    """Whether Arrow opens files of this scheme."""
    first = paths if isinstance(paths, str) else next(iter(paths), "/")
    if re.match(r"(file:)?/", first):
        return True
    try:
        open_path(first)
        return True
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False


def listed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file_path, length) of the files, by Spark's listing; contents are not read.  Empty files give no row."""
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select(F.col("path").alias("file_path"), "length")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_path")


def _lines(stream, most: int) -> Iterator[tuple[int, bytes, bool]]:
    """(line, fragment, whether the line ends with it) of the first ``most`` lines, a block at a time."""
    line, carry = 0, b""
    while line < most:
        block = stream.read(BLOCK)
        data, carry = carry + block, b""
        if block and data.endswith(b"\r"):  # its \n may be in the next block
            data, carry = data[:-1], b"\r"
        at = 0
        for m in _ENDS.finditer(data):
            yield line, data[at:m.start()], True
            line, at = line + 1, m.end()
            if line == most:
                return
        if at < len(data):
            yield line, data[at:], False
        if not block:
            return


def line_facts(stream, lines: int, delimiters: Sequence[str]) -> tuple[list[int], str | None, int, str]:
    """Of a file's first lines: counts of the delimiters, SHA-256 of the first line, how many start with ``{`` and with what the first
    that is not blank starts.  Lines are taken in as they come, whatever their length."""
    counts, top, objects, first = [0] * len(delimiters), hashlib.sha256(), 0, ""
    seen, start = False, {}
    for line, part, _ in _lines(stream, lines):
        seen = True
        for i, d in enumerate(delimiters):
            counts[i] += part.count(d.encode())
        if line == 0:
            top.update(part)
        if line not in start and (head := part.lstrip(b" ")):
            start[line] = head[:1]
            objects += head[:1] == b"{"
            first = first or head[:1].decode("latin-1")
    return counts, top.hexdigest() if seen else None, objects, first


def file_heads(spark: SparkSession, paths: str | Sequence[str], lines: int = 10, probe_bytes: int = 8192, delimiters: Sequence[str] = (",",)) -> DataFrame:
    """A row per file: file_path, length, head (first ``probe_bytes``), counts (of each delimiter in the first ``lines`` lines),
    top (SHA-256 of the first line), objects, first (see :func:`line_facts`).  Reads ``probe_bytes`` and the first
    lines, in blocks of 64 KiB; compressed files are read as text, their head as it is.  A file of no bytes gives no row."""
    schema = pa.schema([("file_path", pa.string()), ("length", pa.int64()), ("head", pa.binary()), ("counts", pa.list_(pa.int64())), ("top", pa.string()),
                        ("objects", pa.int32()), ("first", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for path, length in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = open_path(path)
                with fs.open_input_file(name) as f:
                    head = f.read(probe_bytes)
                with fs.open_input_stream(name, compression="detect") as f:
                    rows.append((path, length, head, *line_facts(f, lines, delimiters)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return listed(spark, paths).mapInArrow(run, "file_path string, length long, head binary, counts array<long>, top string, objects int, first string")
