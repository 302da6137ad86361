"""Readers, format detection, discovery and file predicates (SRC-01..09, 12..14, 17, 18).

Detection work (delimiter, encoding, JSON vs JSON Lines) is done for all files at once by
tasks that read only the files' heads (see ``heads``);
files are then grouped by the detected option and each group is read with one
multi-path ``spark.read`` call.  Nothing reads a file on the driver.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.heads import can_open, file_heads

log = logging.getLogger(__name__)

# Null markers recognised by the readers.
NULL_MARKERS = ["", "NULL", "null", "NA", "N/A", "NaN", "nan", "None"]
# Candidate delimiters in tie-break order.
DELIMITERS = [",", "\t", ";", "|"]


# SRC-02 -------------------------------------------------------------------------------
def first_lines(spark: SparkSession, paths: str | Sequence[str], lines: int, cut: int | None = 65536) -> DataFrame:
    """(file_path, n, value): each file's first ``lines`` lines, cut to their first ``cut`` characters (None: whole).

    Spark's text source has no limit by file, so all lines pass the scan, but only
    these reach the exchange (a group limit before and after it)."""
    # ids increase with the split offset inside a file, so they order its lines
    txt = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file_path"), (F.left("value", F.lit(cut)) if cut else F.col("value")).alias("value"),
                                        F.monotonically_increasing_id().alias("__ln"))
    w = Window.partitionBy("file_path").orderBy("__ln")
    return txt.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= lines).drop("__ln")


def _delimiter_of(head: DataFrame, *keep: Column) -> DataFrame:
    """Per file the most frequent candidate delimiter of its lines (ties -> the earlier candidate, none -> comma)."""
    counts = head.groupBy("file_path").agg(*keep, *[
        F.sum(F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))).alias(f"d{i}") for i, d in enumerate(DELIMITERS)])
    best = F.array_max(F.array(*[F.struct(F.col(f"d{i}").alias("n"), F.lit(-i).alias("i")) for i in range(len(DELIMITERS))]))
    return counts.withColumn("delimiter", F.get(F.array(*map(F.lit, DELIMITERS)), -best["i"])).drop(*[f"d{i}" for i in range(len(DELIMITERS))])


def _header_and_delimiter(spark: SparkSession, paths: str | Sequence[str], lines: int) -> DataFrame:
    """(file_path, delimiter, top): from the files' heads where tasks can open them, else by a scan; top is the SHA-256 of the whole first line."""
    if not can_open(paths):
        return _delimiter_of(first_lines(spark, paths, lines, None), F.min_by(F.sha2("value", 256), "n").alias("top"))
    best = F.array_max(F.transform("counts", lambda n, i: F.struct(n.alias("n"), (-i).alias("i"))))
    return file_heads(spark, paths, lines, 1, DELIMITERS).select("file_path", F.get(F.array(*map(F.lit, DELIMITERS)), -best["i"]).alias("delimiter"), "top")


def detect_delimiters(spark: SparkSession, paths: str | Sequence[str], lines: int = 10) -> DataFrame:
    """Per file: the most frequent candidate delimiter over its first ``lines`` lines (ties -> the earlier candidate, none -> comma)."""
    return _header_and_delimiter(spark, paths, lines).select("file_path", "delimiter")


# SRC-03 -------------------------------------------------------------------------------
def detect_encodings(spark: SparkSession, paths: str | Sequence[str], probe_bytes: int = 8192) -> DataFrame:
    """Per file: BOM -> utf-8-sig / utf-32 / utf-16; else utf-8 if the first
    ``probe_bytes`` decode (cut back to a whole character), else latin-1."""
    if can_open(paths):
        b = file_heads(spark, paths, 0, probe_bytes).select("file_path", F.col("head").alias("__head"))
    else:  # a scan, which holds a whole file as one value
        b = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file_path"), F.substring("content", 1, probe_bytes).alias("__head"))
    h = F.hex(F.substring("__head", 1, 4))
    # drop an incomplete trailing UTF-8 sequence before validating
    trimmed = F.regexp_replace(F.hex("__head"), "(?:[C-F][0-9A-F](?:[89AB][0-9A-F]){0,2})$", "")
    valid = F.is_valid_utf8(F.unhex(trimmed).cast("string"))
    enc = (F.when(h.startswith("EFBBBF"), "utf-8-sig")
           .when(h.startswith("FFFE0000"), "utf-32-le").when(h.startswith("0000FEFF"), "utf-32-be")
           .when(h.startswith("FFFE"), "utf-16-le").when(h.startswith("FEFF"), "utf-16-be")
           .when(valid, "utf-8").otherwise("latin-1"))
    return b.select("file_path", enc.alias("encoding"))


# SRC-01 -------------------------------------------------------------------------------
def apply_null_markers(df: DataFrame, markers: Sequence[str] = tuple(NULL_MARKERS)) -> DataFrame:
    cols = [F.when(F.trim(F.col(f.name)).isin(list(markers)), None).otherwise(F.col(f.name)).alias(f.name)
            if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


#: Types that text becomes, in the order they are tried; rows whose values rule types out first.
TEXT_TYPES, HEAD_ROWS = ("bigint", "double", "boolean", "date", "timestamp_ntz"), 1_000


def infer_types(df: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """String columns -> the first of bigint / double / boolean / date / timestamp to which every non-null
    value converts (bad cells would become null with ``try_cast``).

    One value that does not convert rules a type out, so the first rows leave few; all rows are
    then read for each column's first type left, and once more where that failed, for all others left."""
    src = df.limit(sample_rows) if sample_rows else df
    left = {f.name: list(TEXT_TYPES) for f in df.schema.fields if f.dataType.typeName() == "string"}
    out: dict[str, Column] = {}

    def failing(rows: DataFrame, types: Mapping[str, Sequence[str]]) -> dict[str, tuple[int, list[str]]]:
        """Of each column how many values there are, and to which types some do not convert."""
        tests = [(c, t) for c, ts in types.items() for t in ts]
        aggs = [F.count_if(F.col(c).isNotNull() & F.trim(F.col(c)).try_cast(t).isNull()).alias(f"t{i}") for i, (c, t) in enumerate(tests)]
        row = rows.agg(*aggs, *(F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(types))).first()
        return {c: (row[f"n{i}"], [t for k, (d, t) in enumerate(tests) if d == c and row[f"t{k}"]]) for i, c in enumerate(types)}

    for rows, most in ((src.limit(HEAD_ROWS), None), (src, 1), (src, None)):
        tried = {c: ts[:most] for c, ts in left.items() if ts}
        if not tried:
            break
        for c, (n, bad) in failing(rows, tried).items():
            left[c] = [t for t in left[c] if t not in bad]
            if rows is src and (not n or left[c][:1] == tried[c][:1] or most is None):
                if n and left[c]:
                    out[c] = F.trim(F.col(c)).try_cast(left[c][0])
                left[c] = []
    return df.withColumns(out) if out else df


def read_delimited(spark: SparkSession, paths: str | Sequence[str], delimiter: str | None = None,
                   header: bool = True, markers: Sequence[str] = tuple(NULL_MARKERS),
                   encoding: str | None = None, infer: bool = True, lines: int = 10) -> DataFrame:
    """CSV/TSV: PERMISSIVE read as strings, marker set -> null, then type inference
    by ``try_cast`` (a bad cell becomes null instead of failing the read).

    Files that share a delimiter (detected where none is given) and a whole header line
    (by its SHA-256) are read together; the groups are united by column name, so files may order their
    columns differently or lack some.  The driver holds the groups' path lists, as it
    holds the listing of any read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    heads = _header_and_delimiter(spark, paths, lines)
    if not header:
        heads = heads.withColumn("top", F.lit(None).cast("string"))
    groups = heads.withColumn("delimiter", F.lit(delimiter) if delimiter else F.col("delimiter")).groupBy("delimiter", "top").agg(
        F.sort_array(F.collect_list("file_path")).alias("p")).orderBy(F.col("p")[0])
    parts = []
    for g in groups.collect():  # a row for each header and delimiter
        rd = spark.read.option("header", header).option("sep", g["delimiter"]).option("mode", "PERMISSIVE").option("inferSchema", False)
        parts.append((rd.option("encoding", encoding) if encoding else rd).csv(g["p"]))
    if not parts:
        return spark.createDataFrame([], "value string")
    df = apply_null_markers(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), markers)
    return infer_types(df) if infer else df


# SRC-04 / 05 / 06 ----------------------------------------------------------------------
def detect_json_kind(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Per file: ``jsonl`` by extension (.jsonl/.ndjson), else by its first 5 lines: not
    opening with ``[``, and at least 2 of them starting with ``{``."""
    heads = file_heads(spark, paths, 5, 1).select("file_path", "objects", "first") if can_open(paths) else first_lines(spark, paths, 5).groupBy("file_path").agg(
        F.count_if(F.ltrim("value").startswith("{")).alias("objects"), F.min_by(F.ltrim("value"), F.struct(F.ltrim("value") == "", "n")).alias("first"))
    ext = F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1))
    kind = (F.when(ext.isin(".jsonl", ".ndjson"), "jsonl").when((ext == ".json") & F.col("first").startswith("["), "json")
            .when(F.col("objects") >= 2, "jsonl").otherwise("json"))
    return heads.select("file_path", kind.alias("kind"))


def read_json(spark: SparkSession, paths: str | Sequence[str], lines: bool | None = None) -> DataFrame:
    """JSON array / single object (``multiLine``) or JSON Lines; malformed
    records go to ``_corrupt_record`` (PERMISSIVE)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if lines is None:
        kinds = detect_json_kind(spark, paths).groupBy("kind").agg(F.collect_list("file_path").alias("p")).collect()
        parts = [read_json(spark, r["p"], r["kind"] == "jsonl") for r in kinds]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rd = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return rd.json(paths) if lines else rd.option("multiLine", True).json(paths)


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None) -> DataFrame:
    rd = spark.read.option("mode", "PERMISSIVE")
    if schema:
        rd = rd.schema(schema)
    return rd.json(paths)


# SRC-07 / 09 ------------------------------------------------------------------------------
def read_parquet(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else list(paths)))
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def apply_read_options(df: DataFrame, columns: Sequence[str] | None = None, exclude_columns: Sequence[str] = (),
                       skip_rows: int = 0, row_limit: int | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """columns (unknown ones ignored with a warning), exclude, then skip + limit
    on an explicit order (row order is not defined otherwise)."""
    if columns:
        unknown = [c for c in columns if c not in df.columns]
        if unknown:
            log.warning("ignoring unknown columns %s", unknown)
        df = df.select(*[c for c in columns if c in df.columns])
    if exclude_columns:
        df = df.drop(*[c for c in exclude_columns if c in df.columns])
    if skip_rows or row_limit is not None:
        if not order_by:
            raise ValueError("skip_rows/row_limit need order_by")
        df = df.orderBy(*order_by)
        if skip_rows:
            df = df.offset(skip_rows)
        if row_limit is not None:
            df = df.limit(row_limit)
    return df


# SRC-12 ---------------------------------------------------------------------------------------
READERS: dict[str, Callable[..., DataFrame]] = {
    ".csv": lambda s, p, **kw: read_delimited(s, p, **kw),
    ".tsv": lambda s, p, **kw: read_delimited(s, p, delimiter="\t", **kw),
    ".txt": lambda s, p, **kw: read_delimited(s, p, **kw),
    ".json": lambda s, p, **kw: read_json(s, p, **kw),
    ".jsonl": lambda s, p, **kw: read_json(s, p, lines=True),
    ".ndjson": lambda s, p, **kw: read_json(s, p, lines=True),
    ".parquet": lambda s, p, **kw: read_parquet(s, p, **kw),
}


#: Media types of the formats.
MEDIA_TYPES = {"text/csv": ".csv", "application/csv": ".csv", "text/tab-separated-values": ".tsv", "text/plain": ".txt", "application/json": ".json",
               "application/x-ndjson": ".jsonl", "application/jsonl": ".jsonl", "application/vnd.apache.parquet": ".parquet", "application/x-parquet": ".parquet"}


def reader_for(path: str, readers: Mapping[str, Callable] | None = None, media_type: str | None = None) -> Callable[..., DataFrame]:
    """The reader of a media type, if a known one is given, else of the path's extension."""
    table = {**READERS, **(readers or {})}
    known = MEDIA_TYPES.get((media_type or "").split(";")[0].strip().lower())
    ext = known or os.path.splitext(path)[1].lower()
    if ext not in table:
        raise ValueError(f"unsupported file type {ext}")
    return table[ext]


def read_any(spark: SparkSession, path: str, readers: Mapping[str, Callable] | None = None, media_type: str | None = None, **kw) -> DataFrame:
    return reader_for(path, readers, media_type)(spark, path, **kw)


# SRC-13 / 14 -----------------------------------------------------------------------------------
def discover_files(spark: SparkSession, root: str, recursive: bool = True, glob: str | None = None,
                   exclude: Sequence[str] = (), max_files: int | None = None,
                   supported: Sequence[str] = tuple(READERS)) -> DataFrame:
    """File listing via the ``binaryFile`` source without reading contents:
    path, file name, extension, size, modified time, supported flag."""
    rd = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        rd = rd.option("pathGlobFilter", glob)
    df = rd.load(root).select("path", "length", "modificationTime")
    df = df.select(F.col("path").alias("full_path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
                   F.regexp_replace("path", r"/[^/]*$", "").alias("path"),
                   F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"),
                   F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    for x in exclude:
        df = df.filter(~F.col("full_path").contains(x))
    df = df.withColumn("supported", F.col("extension").isin(list(supported)))
    if max_files:
        df = df.orderBy("full_path").limit(max_files)
    return df


_FIELD_COLS = {"filename": "filename", "extension": "extension", "path": "path", "full_path": "full_path",
               "size": "size", "modified_date": "modified"}


def file_predicate(node: Mapping[str, Any], field_cols: Mapping[str, str] | None = None) -> Column:
    """Compile an AND/OR/NOT tree of ``{field, operator, value, case_sensitive}``
    leaves to one Column (NOT uses its first child)."""
    cols = {**_FIELD_COLS, **(field_cols or {})}
    if "and" in node or node.get("type") == "and":
        kids = node.get("and") or node.get("children") or []
        return reduce(lambda a, b: a & b, [file_predicate(k, cols) for k in kids])
    if "or" in node or node.get("type") == "or":
        kids = node.get("or") or node.get("children") or []
        return reduce(lambda a, b: a | b, [file_predicate(k, cols) for k in kids])
    if "not" in node or node.get("type") == "not":
        kids = node.get("not") or node.get("children") or []
        kid = kids[0] if isinstance(kids, list) else kids
        return ~file_predicate(kid, cols)
    c = F.col(cols.get(node["field"], node["field"]))
    op, val = node["operator"], node.get("value")
    ci = not node.get("case_sensitive", False)
    is_text = isinstance(val, str) or (isinstance(val, list) and val and isinstance(val[0], str))
    if ci and is_text:
        c = F.lower(c.cast("string"))
        val = [v.lower() for v in val] if isinstance(val, list) else val.lower()
    ops = {
        "equals": lambda: c == F.lit(val), "not_equals": lambda: c != F.lit(val),
        "contains": lambda: c.contains(val), "startswith": lambda: c.startswith(val),
        "endswith": lambda: c.endswith(val), "matches": lambda: c.rlike(val),
        "gt": lambda: c > F.lit(val), "gte": lambda: c >= F.lit(val), "lt": lambda: c < F.lit(val),
        "lte": lambda: c <= F.lit(val), "in": lambda: c.isin(list(val)), "not_in": lambda: ~c.isin(list(val)),
    }
    if op not in ops:
        raise ValueError(f"unknown file predicate operator {op}")
    return ops[op]()


# SRC-17 ------------------------------------------------------------------------------------
def read_many(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
              renames: Mapping[str, str] | None = None) -> DataFrame:
    """One multi-path read per format (schemas merged), renames, diagonal union."""
    if fmt == "parquet":
        df = spark.read.option("mergeSchema", True).parquet(*paths)
    elif fmt == "csv":
        df = read_delimited(spark, list(paths))
    else:
        df = read_json(spark, list(paths))
    if renames:
        df = df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})
    return df


# SRC-18 ------------------------------------------------------------------------------------
def read_dataset(spark: SparkSession, base: str, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """Dataset rows and its one-row manifest."""
    return spark.read.parquet(f"{base}/{dataset_id}/data"), spark.read.json(f"{base}/{dataset_id}/manifest")


def list_datasets(spark: SparkSession, base: str, tool: str | None = None, limit: int | None = None) -> DataFrame:
    cat = spark.read.json(f"{base}/*/manifest")
    if tool:
        cat = cat.filter(F.col("tool") == tool)
    cat = cat.orderBy(F.col("created_at").desc(), F.col("dataset_id"))
    return cat.limit(limit) if limit else cat

