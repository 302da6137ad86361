"""Schema probe, file pre-checks and table availability (SRC-10, 11, 15, 16).

A probe is ONE aggregate over all columns (counts, null counts, distinct
counts) unpivoted to one row per column; samples come from a bounded top-n.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def probe_type(dt: T.DataType) -> str:
    """Physical type -> probe type family (decimal folds into float)."""
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, T.BinaryType):
        return "binary"
    if isinstance(dt, T.NullType):
        return "null"
    return "unknown"


def probe_schema(df: DataFrame, samples: int = 10, order_by: Sequence[str] | None = None,
                 approx: bool = False) -> DataFrame:
    """One row per column: name, position, type, nullable, null_count,
    distinct_count, row_count, samples (first non-null values by ``order_by``)."""
    cols = df.columns
    dc = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nn{i}"), dc(F.col(c)).alias(f"dc{i}")]
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{c}', {i}, '{probe_type(df.schema[c].dataType)}', nn{i}, dc{i}" for i, c in enumerate(cols))
    long = wide.selectExpr("__n AS row_count",
                           f"stack({len(cols)}, {parts}) AS (column_name, position, inferred_type, null_count, distinct_count)")
    order = list(order_by) if order_by else cols[:1]
    keys = F.struct(*[F.col(o) for o in order]).alias("o")
    # the first values that are there, by column: one bounded top-n each over two narrow columns
    first = [df.select(keys, F.col(c).cast("string").alias("v")).where("v IS NOT NULL").orderBy("o", "v").limit(samples)
             .select(F.lit(c).alias("column_name"), "o", "v") for c in cols]
    samp = reduce(DataFrame.unionByName, first).groupBy("column_name").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]), "|").alias("samples"))
    return (long.join(samp, "column_name", "left")
            .select("column_name", F.col("position").cast("int").alias("position"), "inferred_type",
                    (F.col("null_count") > 0).alias("nullable"), "null_count", "distinct_count", "row_count",
                    "samples"))


#: Largest file that is parsed as one value (a row of Spark holds less than 2 GiB).
MOST_BYTES = 1 << 30


def estimate_rows(file_bytes: int, sample_lines: Sequence[str]) -> int:
    """Large-file row estimate = file bytes / average sampled line bytes."""
    if not sample_lines:
        return 0
    avg = sum(len(s.encode()) + 1 for s in sample_lines) / len(sample_lines)
    return int(file_bytes / avg) if avg else 0


# SRC-11 -------------------------------------------------------------------------------------
def precheck_files(spark: SparkSession, paths: str | Sequence[str], kind: str = "json") -> DataFrame:
    """Issues per file with severity / code / suggestion: empty, not UTF-8,
    not parseable JSON, JSON array with non-object elements.  A file beyond ``MOST_BYTES`` does not fit
    one value: it gets a warning that says so, and only its size is checked."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file_path"), "length", "content")
    large = files.where(F.col("length") > MOST_BYTES).select("file_path", F.lit("warning").alias("severity"), F.lit("TOO_LARGE").alias("code"), F.lit("not checked as a whole; read it in chunks").alias("suggestion"))
    b = files.where(F.col("length") <= MOST_BYTES)
    text = F.col("content").cast("string")
    doc = F.try_parse_json(text)
    issues = [
        F.when(F.col("length") == 0, F.struct(F.lit("error").alias("severity"), F.lit("EMPTY_FILE").alias("code"),
                                             F.lit("file is empty").alias("suggestion"))),
        F.when((F.col("length") > 0) & ~F.is_valid_utf8(text),
               F.struct(F.lit("error").alias("severity"), F.lit("ENCODING").alias("code"),
                        F.lit("file is not valid UTF-8; pass an encoding").alias("suggestion"))),
    ]
    if kind == "json":
        arr = F.try_variant_get(doc, "$", "array<variant>")
        non_obj = F.exists(arr, lambda x: ~F.schema_of_variant(x).startswith("OBJECT"))
        issues += [
            F.when((F.col("length") > 0) & F.is_valid_utf8(text) & doc.isNull(),
                   F.struct(F.lit("error").alias("severity"), F.lit("INVALID_JSON").alias("code"),
                            F.lit("fix the JSON syntax or use JSON Lines").alias("suggestion"))),
            F.when(F.coalesce(non_obj, F.lit(False)),
                   F.struct(F.lit("warning").alias("severity"), F.lit("NON_OBJECT_ROWS").alias("code"),
                            F.lit("array elements should be objects").alias("suggestion"))),
        ]
    out = (b.select("file_path", F.explode(F.filter(F.array(*issues), lambda x: x.isNotNull())).alias("i"))
           .select("file_path", "i.*"))
    out = out.unionByName(large)
    if not isinstance(paths, str):
        # zero-length files give no row: hold the caller's list against what was read
        bare = F.regexp_replace("file_path", "^[a-z]+:/*", "/")
        asked = spark.createDataFrame([(p,) for p in paths], "file_path string")
        gone = asked.withColumn("__p", bare).join(files.select(bare.alias("__p")), "__p", "left_anti").select(
            "file_path", F.lit("error").alias("severity"), F.lit("EMPTY_FILE").alias("code"), F.lit("file is empty or missing").alias("suggestion"))
        out = out.unionByName(gone)
    return out


# SRC-15 / 16 ----------------------------------------------------------------------------------
def table_availability(tables: DataFrame, expected: Mapping[str, Sequence[str]], file_col: str = "file_path",
                       table_col: str = "table_id") -> DataFrame:
    """Per (file, table) that was tried: AVAILABLE, PARTIAL (expected columns missing) or
    FAILED (no rows, or unreadable).  ``tables`` is the long form (file, table, column_name)
    of what was read; a table without rows, or that could not be read, has one row with a
    null column, and a file of unknown format one with a null table (``<unknown>``)."""
    exp = tables.sparkSession.createDataFrame([(t, list(cols)) for t, cols in expected.items()], f"{table_col} string, expected array<string>")
    named = tables.withColumn(table_col, F.coalesce(table_col, F.lit("<unknown>")))
    j = named.groupBy(file_col, table_col).agg(F.collect_set("column_name").alias("actual")).join(exp, table_col, "left")
    none = F.array().cast("array<string>")
    failed = F.size("actual") == 0
    missing = F.when(failed, none).otherwise(F.array_except(F.coalesce("expected", none), "actual"))
    status = F.when(failed, "FAILED").when(F.size(missing) > 0, "PARTIAL").otherwise("AVAILABLE")
    return j.select(file_col, table_col, status.alias("status"), missing.alias("missing_columns"))


def select_tables(avail: DataFrame, wanted: Sequence[str] | None = None, file_col: str = "file_path",
                  table_col: str = "table_id") -> DataFrame:
    """All AVAILABLE tables, or the wanted ones that are AVAILABLE; file -> tables map."""
    ok = avail.filter(F.col("status") == "AVAILABLE")
    if wanted:
        ok = ok.filter(F.col(table_col).isin(list(wanted)))
    return ok.groupBy(file_col).agg(F.sort_array(F.collect_list(table_col)).alias("tables"))
