"""Sinks: dataset write with manifest, exports, naming and stable ids (SNK-01..05).

The manifest's row count and null counts come from ``DataFrame.observe``
metrics collected while the data is written, so no second scan is needed.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.sources.heads import open_path

ID_SEED = 42
#: Bytes of a file that are held at a time while files are joined.
JOIN_BYTES = 8 << 20
_UNSAFE = r'[<>:"/\\|?*]'


def join_files(spark: SparkSession, folder: str, path: str, head: bytes = b"") -> None:
    """One file at ``path`` from ``head`` and the part files that Spark wrote to ``folder``, in their order.

    The rows were sorted and formatted by many tasks; one task only copies their bytes, a stretch at a time, to a name of its
    own that becomes ``path`` at the end, so a task run again does no harm."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            (fs, root), (to, name) = open_path(folder), open_path(path)
            parts = sorted((f.path for f in fs.get_file_info(FileSelector(root)) if f.base_name.startswith("part-")), key=lambda f: (len(f), f))
            to.create_dir(name.rsplit("/", 1)[0], recursive=True)
            own = f"{name}.{uuid.uuid4().hex}.tmp"
            with to.open_output_stream(own) as out:
                out.write(head)
                for part in parts:
                    with fs.open_input_stream(part) as f:
                        while data := f.read(JOIN_BYTES):
                            out.write(data)
            to.move(own, name)
            yield b

    spark.range(0, 1, 1, 1).mapInArrow(run, "id long").collect()


def drop_folder(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# SNK-05 -----------------------------------------------------------------------------------
def stable_id(payload: Mapping[str, Any], length: int = 8, seed: int = ID_SEED) -> str:
    """SHA-256 of sorted-key compact JSON with ``_seed``; first ``length`` hex chars."""
    body = json.dumps({**payload, "_seed": seed}, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(body.encode()).hexdigest()[:length]


def dataset_id(run_id: str, columns: Sequence[str], row_count: int, levels: Sequence[str] = ()) -> str:
    return stable_id({"run_id": run_id, "columns": sorted(columns), "row_count": row_count,
                      "levels": list(levels)})


def row_id(columns: Sequence[str], seed: int = ID_SEED, length: int = 8) -> Column:
    """Per-row id: sha2 of sorted-key compact JSON (``_seed`` included), first ``length`` hex."""
    fields = sorted(list(columns) + ["_seed"])
    st = F.struct(*[(F.lit(seed) if c == "_seed" else F.col(c)).alias(c) for c in fields])
    return F.substring(F.sha2(F.to_json(st, {"ignoreNullFields": "false"}), 256), 1, length)


# SNK-04 -----------------------------------------------------------------------------------
def sanitize_name(name: str) -> str:
    s = re.sub(_UNSAFE, "_", name)
    s = re.sub(r"_+", "_", s)
    return s.strip("_")


def sanitize_name_col(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, _UNSAFE, "_"), "_+", "_"), "^_+|_+$", "")


def output_name(template: str = "{profile_id}_{timestamp}", **values) -> str:
    values.setdefault("timestamp", dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d_%H%M%S"))
    return sanitize_name(template.format(**values))


# SNK-01 -----------------------------------------------------------------------------------
def write_dataset(df: DataFrame, base: str, dataset: str, lineage: Sequence[str] = (), tool: str = "quarry",
                  mode: str = "overwrite", partition_by: Sequence[str] = ()) -> dict[str, Any]:
    """Parquet data + one-row manifest (columns, types, nullable, row count, lineage)."""
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.count_if(F.col(c).isNull()).alias(f"null_{i}")
                                                  for i, c in enumerate(df.columns)]
    obs = Observation(f"manifest_{dataset}")
    observed = df.observe(obs, *aggs)
    w = observed.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{base}/{dataset}/data")
    m = obs.get
    spark = df.sparkSession
    # the files' sizes, from their listing
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(
        f"{base}/{dataset}/data").agg(F.sum("length")).first()[0]
    manifest = {
        "dataset_id": dataset, "tool": tool,
        "created_at": dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "row_count": int(m["rows"]),
        "size_bytes": int(size or 0),
        "columns": [{"name": f.name, "dtype": f.dataType.simpleString(), "nullable": int(m[f"null_{i}"]) > 0}
                    for i, f in enumerate(df.schema.fields)],
        "parent_ids": list(lineage),
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{base}/{dataset}/manifest")
    return manifest


# SNK-02 / 03 ------------------------------------------------------------------------------
def export(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode(mode).json(path)
    else:
        raise ValueError(f"unknown export format {fmt}")


def write_tables(tables: Mapping[str, DataFrame], base: str, fmt: str = "parquet",
                 combined: bool = True, tag: str = "__table_id__") -> None:
    """One output per table plus one combined output partitioned by table id."""
    from quarry.operators.joins import combine_tagged

    for name, df in tables.items():
        export(df, f"{base}/{sanitize_name(name)}", fmt)
    if combined and tables:
        combine_tagged(dict(tables), tag).write.mode("overwrite").partitionBy(tag).parquet(f"{base}/_combined")
