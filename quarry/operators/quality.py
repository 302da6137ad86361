"""Validation / data quality (VAL-01..08).

All rules of a table are evaluated in **one** aggregate (many ``count_if``
columns), then turned into long-form result rows with ``stack``; never one
job per rule.  Results are DataFrames with columns
``table_name, rule, column_name, violations, severity, passed``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPE_FAMILIES = {
    "string": (T.StringType,),
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "bool": (T.BooleanType,),
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
}


def _long(wide: DataFrame, table_name: str, entries: list[tuple[str, str, str, str]]) -> DataFrame:
    """entries: (alias in wide, rule, column, severity) -> long result rows."""
    if not entries:
        schema = "table_name string, rule string, column_name string, violations bigint, severity string, passed boolean"
        return wide.sparkSession.createDataFrame([], schema)
    parts = ", ".join(f"'{r}', '{c}', CAST(`{a}` AS BIGINT), '{s}'" for a, r, c, s in entries)
    return (wide.selectExpr(f"stack({len(entries)}, {parts}) AS (rule, column_name, violations, severity)")
            .select(F.lit(table_name).alias("table_name"), "rule", "column_name", "violations", "severity",
                    (F.col("violations") == 0).alias("passed")))


# VAL-01 -----------------------------------------------------------------------
def stable_columns(df: DataFrame, expected: Sequence[str], mode: str = "warn", subset: bool = False,
                   table_name: str = "table") -> list[dict[str, Any]]:
    """Missing columns, and extra columns unless ``subset``; metadata only (no job)."""
    if mode == "ignore":
        return []
    missing = [c for c in expected if c not in df.columns]
    extra = [] if subset else [c for c in df.columns if c not in expected]
    issues = []
    sev = "error" if mode == "error" else "warning"
    if missing:
        issues.append({"table_name": table_name, "rule": "missing_columns", "columns": missing, "severity": sev})
    if extra:
        issues.append({"table_name": table_name, "rule": "extra_columns", "columns": extra, "severity": sev})
    if mode == "error" and issues:
        raise ValueError(f"stable column check failed for {table_name}: {issues}")
    return issues


# VAL-02 -----------------------------------------------------------------------
def value_constraints(df: DataFrame, constraints: Mapping[str, Mapping[str, Any]], table_name: str = "table",
                      severity: str = "error") -> DataFrame:
    """``{column: {min?, max?, not_null?, regex?}}``; nulls are not counted by range/regex."""
    aggs, entries = [], []
    for i, (c, rule) in enumerate(constraints.items()):
        if c not in df.columns:
            continue
        col = F.col(c)
        if rule.get("min") is not None:
            aggs.append(F.count_if(col < F.lit(rule["min"])).alias(f"a{i}_min"))
            entries.append((f"a{i}_min", "below_min", c, severity))
        if rule.get("max") is not None:
            aggs.append(F.count_if(col > F.lit(rule["max"])).alias(f"a{i}_max"))
            entries.append((f"a{i}_max", "above_max", c, severity))
        if rule.get("not_null"):
            aggs.append(F.count_if(col.isNull()).alias(f"a{i}_nn"))
            entries.append((f"a{i}_nn", "not_null", c, severity))
        if rule.get("regex"):
            aggs.append(F.count_if(col.isNotNull() & ~col.cast("string").rlike(rule["regex"])).alias(f"a{i}_rx"))
            entries.append((f"a{i}_rx", "regex", c, severity))
    wide = df.agg(*aggs) if aggs else df.limit(1)
    return _long(wide, table_name, entries)


# VAL-03 -----------------------------------------------------------------------
def schema_rules(df: DataFrame, required: Sequence[str] = (), types: Mapping[str, str] | None = None,
                 unique: Sequence[str] = (), table_name: str = "table") -> DataFrame:
    """Required columns and type families from the schema (driver metadata);
    unique columns: duplicates = rows - (distinct non-null + 1 if any null)."""
    spark = df.sparkSession
    meta = []
    for c in required:
        meta.append((table_name, "required", c, 0 if c in df.columns else 1, "error"))
    for c, fam in (types or {}).items():
        ok = c in df.columns and isinstance(df.schema[c].dataType, _TYPE_FAMILIES.get(fam, ()))
        meta.append((table_name, f"type_{fam}", c, 0 if ok else 1, "error"))
    aggs, entries = [F.count(F.lit(1)).alias("__n")], []
    for i, c in enumerate(u for u in unique if u in df.columns):
        aggs.append((F.count(F.lit(1)) - (F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))))
                    .alias(f"u{i}"))
        entries.append((f"u{i}", "unique", c, "error"))
    out = _long(df.agg(*aggs), table_name, entries)
    if meta:
        m = spark.createDataFrame(meta, "table_name string, rule string, column_name string, violations bigint, "
                                        "severity string").withColumn("passed", F.col("violations") == 0)
        out = m.unionByName(out)
    return out


# VAL-04 -----------------------------------------------------------------------
def row_rules(df: DataFrame, rules: Sequence[Mapping[str, Any]], table_name: str = "table") -> DataFrame:
    """``[{name, expr, on_fail}]``: violations = rows where the expression is not
    true (null counts as a violation).  The full Spark SQL grammar is accepted."""
    aggs, entries = [], []
    for i, r in enumerate(rules):
        pred = F.expr(r["expr"])
        aggs.append(F.count_if(~F.coalesce(pred, F.lit(False))).alias(f"r{i}"))
        entries.append((f"r{i}", r.get("name", f"rule_{i}"), r.get("column", ""),
                        "error" if r.get("on_fail") == "error" else "warning"))
    return _long(df.agg(*aggs), table_name, entries)


# VAL-05 -----------------------------------------------------------------------
def aggregate_rules(df: DataFrame, rules: Sequence[Mapping[str, Any]], table_name: str = "table") -> DataFrame:
    """row_count min/max, unique_count min per column, null_ratio max per column.
    Output adds ``value`` (the measured statistic) and ``passed``."""
    aggs, rows = [F.count(F.lit(1)).alias("__n")], []
    for i, r in enumerate(rules):
        kind, c = r["type"], r.get("column")
        if kind == "row_count":
            val = F.col("__n").cast("double")
        elif kind == "unique_count":
            aggs.append(F.count_distinct(F.col(c)).alias(f"g{i}"))
            val = F.col(f"g{i}").cast("double")
        elif kind == "null_ratio":
            aggs.append(F.count_if(F.col(c).isNull()).alias(f"g{i}"))
            val = F.when(F.col("__n") > 0, F.col(f"g{i}") / F.col("__n")).otherwise(F.lit(0.0))
        else:
            raise ValueError(f"unknown aggregate rule {kind}")
        ok = F.lit(True)
        if r.get("min") is not None:
            ok = ok & (val >= F.lit(r["min"]))
        if r.get("max") is not None:
            ok = ok & (val <= F.lit(r["max"]))
        rows.append(F.struct(F.lit(kind).alias("rule"), F.lit(c or "").alias("column_name"),
                             val.alias("value"), ok.alias("passed")))
    wide = df.agg(*aggs)
    return (wide.select(F.explode(F.array(*rows)).alias("r"))
            .select(F.lit(table_name).alias("table_name"), "r.rule", "r.column_name", "r.value", "r.passed"))


# VAL-06 -----------------------------------------------------------------------
def validation_summary(results: Sequence[DataFrame], expected_tables: Sequence[str] = ()) -> DataFrame:
    """Per table: valid (no failed error), errors, warnings; tables that were not
    extracted appear with one warning."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    summary = out.groupBy("table_name").agg(
        F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("errors"),
        F.count_if(~F.col("passed") & (F.col("severity") == "warning")).alias("warnings"))
    if expected_tables:
        spark = out.sparkSession
        exp = spark.createDataFrame([(t,) for t in expected_tables], "table_name string")
        missing = exp.join(summary, "table_name", "left_anti").select(
            "table_name", F.lit(0).cast("bigint").alias("errors"), F.lit(1).cast("bigint").alias("warnings"))
        summary = summary.unionByName(missing)
    return summary.withColumn("valid", F.col("errors") == 0)


# VAL-07 -----------------------------------------------------------------------
def quarantine_split(df: DataFrame, rules: Mapping[str, str | Column]) -> tuple[DataFrame, DataFrame]:
    """Row-level quarantine: (good rows, bad rows + ``failed_rules`` array).

    One expression computes the array of failed rule names per row; both
    outputs derive from it, so each is a single filter over the same plan."""
    checks = [F.when(~F.coalesce(F.expr(p) if isinstance(p, str) else p, F.lit(False)), F.lit(name))
              for name, p in rules.items()]
    tagged = df.withColumn("failed_rules", F.filter(F.array(*checks), lambda x: x.isNotNull()))
    good = tagged.filter(F.size("failed_rules") == 0).drop("failed_rules")
    bad = tagged.filter(F.size("failed_rules") > 0)
    return good, bad


# VAL-08 -----------------------------------------------------------------------
def factor_levels_check(df: DataFrame, factors: Sequence[str], response: str, min_rows: int = 10,
                        min_levels: int = 2, max_null_share: float = 0.5) -> DataFrame:
    """SOV input contract in one aggregate: required columns, numeric response,
    >= min_rows rows, >= min_levels levels per factor, response null share."""
    spark = df.sparkSession
    cols = [*factors, response]
    missing = [c for c in cols if c not in df.columns]
    numeric = response in df.columns and isinstance(df.schema[response].dataType, T.NumericType)
    meta = [("required_columns", len(missing) == 0, ",".join(missing)),
            ("numeric_response", bool(numeric), response)]
    if missing:
        return spark.createDataFrame(meta, "check string, passed boolean, detail string")
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(response).isNull()).alias("nulls")]
    aggs += [F.count_distinct(F.col(f)).alias(f"lv{i}") for i, f in enumerate(factors)]
    wide = df.agg(*aggs)
    checks = [F.struct(F.lit("min_rows").alias("check"), (F.col("n") >= min_rows).alias("passed"),
                       F.col("n").cast("string").alias("detail")),
              F.struct(F.lit("null_share").alias("check"),
                       (F.when(F.col("n") > 0, F.col("nulls") / F.col("n")).otherwise(F.lit(0.0)) <= max_null_share)
                       .alias("passed"),
                       F.col("nulls").cast("string").alias("detail"))]
    checks += [F.struct(F.lit(f"levels_{f}").alias("check"), (F.col(f"lv{i}") >= min_levels).alias("passed"),
                        F.col(f"lv{i}").cast("string").alias("detail")) for i, f in enumerate(factors)]
    data_checks = wide.select(F.explode(F.array(*checks)).alias("c")).select("c.check", "c.passed", "c.detail")
    return spark.createDataFrame(meta, "check string, passed boolean, detail string").unionByName(data_checks)
