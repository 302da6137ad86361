"""Projection and column transforms (PRJ-01..18).

Every function takes a DataFrame plus configuration and returns a DataFrame.
The driver only loops over configuration (columns, rules); all data work is a
column expression that stays inside whole-stage codegen.  User data is parsed
with ``try_*`` functions because ANSI mode is on in Spark 4.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

# Default unit mapping to nanometres (unit -> factor).
DEFAULT_UNIT_FACTORS: dict[str, float] = {
    "nm": 1,
    "um": 1000,
    "μm": 1000,
    "mm": 1_000_000,
    "m": 1_000_000_000,
    "angstrom": 0.1,
    "Å": 0.1,
}

# Currency symbols for value formatting.
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£"}


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# PRJ-01 -------------------------------------------------------------------
def rename_columns(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist; unknown names are ignored."""
    valid = {k: v for k, v in (renames or {}).items() if k in df.columns}
    return df.withColumnsRenamed(valid) if valid else df


# PRJ-02 -------------------------------------------------------------------
_CAST_TYPES = {
    "int64": "bigint", "int": "bigint", "integer": "bigint", "long": "bigint",
    "float64": "double", "float": "double", "double": "double",
    "string": "string", "str": "string", "bool": "boolean", "boolean": "boolean",
}


def apply_column_overrides(df: DataFrame, overrides: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Per-column override list: ``{column, drop?, rename?, dtype?}`` in order."""
    for ov in overrides or []:
        name = ov.get("column")
        if name not in df.columns:
            continue
        if ov.get("drop"):
            df = df.drop(name)
            continue
        if ov.get("dtype"):
            target = _CAST_TYPES.get(str(ov["dtype"]).lower(), str(ov["dtype"]))
            df = df.withColumn(name, F.col(name).try_cast(target))
        if ov.get("rename"):
            df = df.withColumnRenamed(name, ov["rename"])
    return df


# PRJ-03 -------------------------------------------------------------------
def replace_null_markers(df: DataFrame, markers: Iterable[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Turn marker strings (e.g. ``NA``) into nulls on string columns."""
    markers = list(markers or [])
    if not markers:
        return df
    targets = [c for c in (columns or _string_columns(df)) if c in _string_columns(df)]
    return df.withColumns({c: F.when(F.col(c).isin(markers), F.lit(None)).otherwise(F.col(c)) for c in targets})


# PRJ-04 -------------------------------------------------------------------
def numeric_coercion_plan(df: DataFrame, columns: Sequence[str] | None = None, max_fail_ratio: float = 0.5) -> list[str]:
    """Decide which string columns become double: one aggregate over all of them.

    A column converts when fewer than ``max_fail_ratio`` of its non-null
    values fail to parse.  The whole column is judged (not a first-N sample),
    so the decision does not depend on partitioning.
    """
    cands = [c for c in (columns or _string_columns(df)) if c in _string_columns(df)]
    if not cands:
        return []
    aggs = []
    for i, c in enumerate(cands):
        v = F.trim(F.col(c))
        aggs.append(F.count(c).alias(f"n{i}"))
        aggs.append(F.count_if(v.isNotNull() & v.try_cast("double").isNull()).alias(f"f{i}"))
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cands):
        n, bad = row[f"n{i}"], row[f"f{i}"]
        if n and bad / n < max_fail_ratio:
            out.append(c)
    return out


def auto_numeric_coercion(df: DataFrame, columns: Sequence[str] | None = None, max_fail_ratio: float = 0.5) -> DataFrame:
    chosen = numeric_coercion_plan(df, columns, max_fail_ratio)
    return df.withColumns({c: F.trim(F.col(c)).try_cast("double") for c in chosen}) if chosen else df


# PRJ-05 -------------------------------------------------------------------
# Strptime directive -> Java DateTimeFormatter pattern.
_STRPTIME_TO_JAVA = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD",
    "%I": "hh", "%p": "a", "%z": "Z", "%a": "EEE", "%A": "EEEE", "%%": "%",
}


def strptime_to_java(fmt: str) -> str:
    """Translate a Python strptime format into a Java datetime pattern."""
    out, i = [], 0
    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in _STRPTIME_TO_JAVA:
            out.append(_STRPTIME_TO_JAVA[tok])
            i += 2
            continue
        ch = fmt[i]
        out.append(f"'{ch}'" if ch.isalpha() else ("''" if ch == "'" else ch))
        i += 1
    return "".join(out)


def _parsed_time(default_format: str) -> Callable[[Column, Mapping[str, Any]], Column]:
    def parse(c: Column, options: Mapping[str, Any]) -> Column:
        return F.try_to_timestamp(c.cast("string"), F.lit(strptime_to_java(options.get("format", default_format)))).cast("timestamp_ntz")

    return parse


#: Options of a text target, applied in this order.
_TEXT_STEPS = (("strip", F.trim), ("uppercase", F.upper), ("lowercase", F.lower))


def _as_text(c: Column, options: Mapping[str, Any]) -> Column:
    return reduce(lambda text, step: step[1](text) if options.get(step[0]) else text, _TEXT_STEPS, c.cast("string"))


#: Target type -> handler (column, options) -> column; null where a value does not parse.
COERCIONS: dict[str, Callable[[Column, Mapping[str, Any]], Column]] = {
    "datetime": _parsed_time("%Y-%m-%d %H:%M:%S"),
    "date": lambda c, options: _parsed_time("%Y-%m-%d")(c, options).cast("date"),
    "string": _as_text,
    "float": lambda c, _: c.try_cast("double"),
    "int": lambda c, _: c.try_cast("bigint"),
    "bool": lambda c, _: c.try_cast("boolean"),
}


def coerce_types(df: DataFrame, coercions: Sequence[Mapping[str, Any]] | None, on_error: str = "null") -> DataFrame:
    """``{column, to_type, ...options}`` for the columns that the table has, in one projection.

    A value that does not parse becomes null; with ``on_error="raise"`` the job
    fails on it.  Later entries for a column work on the result of earlier ones;
    an unknown target type raises."""
    out: dict[str, Column] = {}
    for rule in coercions or []:
        name, target = rule.get("column"), rule.get("to_type")
        if target not in COERCIONS:
            raise ValueError(f"unknown type {target!r}; known: {', '.join(COERCIONS)}")
        if name not in df.columns:
            continue
        before = out.get(name, F.col(name))
        after = COERCIONS[target](before, rule)
        if on_error == "raise":
            failed = F.raise_error(F.lit(f"a value of {name} is no {target}"))
            after = F.when(before.isNotNull() & after.isNull(), failed).otherwise(after)
        out[name] = after
    return df.withColumns(out) if out else df


# PRJ-06 / PRJ-07 / PRJ-08 ---------------------------------------------------
def unit_factor(from_unit: str, to_unit: str | None = None, units: Mapping[str, float] | None = None) -> float | None:
    table = {**DEFAULT_UNIT_FACTORS, **(units or {})}
    if from_unit not in table:
        return None
    to_unit = to_unit or "nm"
    if to_unit not in table:
        return None
    return table[from_unit] / table[to_unit]


def unit_convert(df: DataFrame, column: str, from_unit: str | None = None, to_unit: str | None = None,
                 unit_column: str | None = None, units: Mapping[str, float] | None = None,
                 target: str | None = None) -> DataFrame:
    """Convert a column to ``to_unit`` (default nm).

    Either one unit for the whole column (``from_unit``) or a per-row unit
    column (``unit_column``) looked up in a literal map; unknown units give
    null for the per-row form and leave the column unchanged otherwise.
    """
    if column not in df.columns:
        return df
    target = target or column
    # a cell of a text column that is no number becomes null
    number = F.col(column).try_cast("double") if isinstance(df.schema[column].dataType, T.StringType) else F.col(column)
    table = {**DEFAULT_UNIT_FACTORS, **(units or {})}
    to_f = table.get(to_unit or "nm")
    if to_f is None:
        return df
    if unit_column:
        m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])
        return df.withColumn(target, number * F.try_element_at(m, F.col(unit_column)) / F.lit(float(to_f)))
    fac = unit_factor(from_unit, to_unit, units)
    if fac is None:
        return df
    return df.withColumn(target, number * F.lit(fac))


def apply_units_policy(df: DataFrame, policy: str, column_units: Mapping[str, str],
                       units: Mapping[str, float] | None = None, to_unit: str = "nm") -> DataFrame:
    """``preserve`` (no change), ``normalize`` (convert each listed column), ``strip`` (values kept, unit dropped)."""
    if policy != "normalize":
        return df
    for col, unit in (column_units or {}).items():
        df = unit_convert(df, col, unit, to_unit, units=units)
    return df


def column_transforms(df: DataFrame, transforms: Sequence[Mapping[str, Any]],
                      units: Mapping[str, float] | None = None) -> DataFrame:
    """``{source, target, transform, args}`` with transform in rename, unit_convert,
    uppercase, lowercase, strip, round.  After ``rename`` the source is gone."""
    for t in transforms or []:
        src, tgt, kind, args = t["source"], t.get("target") or t["source"], t["transform"], t.get("args") or {}
        if src not in df.columns:
            continue
        c = F.col(src)
        if kind == "rename":
            df = df.withColumnRenamed(src, tgt)
            continue
        if kind == "unit_convert":
            if "factor" in args:
                new = c * F.lit(args["factor"])
            else:
                fac = unit_factor(args.get("from_unit"), args.get("to_unit"), units)
                if fac is None:
                    continue
                new = c * F.lit(fac)
        elif kind == "uppercase":
            new = F.upper(c.cast("string"))
        elif kind == "lowercase":
            new = F.lower(c.cast("string"))
        elif kind == "strip":
            new = F.trim(c.cast("string"))
        elif kind == "round":
            new = F.round(c, int(args.get("decimals", 2)))
        else:
            log.warning("unknown transform %s", kind)
            continue
        df = df.withColumn(tgt, new)
    return df


# PRJ-09 -------------------------------------------------------------------
_OPS = {"+": "__add__", "-": "__sub__", "*": "__mul__"}


def calculated_column(df: DataFrame, name: str, left: str | float, op: str, right: str | float,
                      round_to: int | None = None) -> DataFrame:
    """Single binary ``+ - * /`` of column/number; division by zero gives null."""

    def operand(x):
        if isinstance(x, str):
            if x not in df.columns:
                raise ValueError(f"unknown column {x}")
            return F.col(x)
        return F.lit(x)

    a, b = operand(left), operand(right)
    if op == "/":
        expr = F.try_divide(a.cast("double"), b.cast("double"))
    elif op in _OPS:
        expr = getattr(a, _OPS[op])(b)
    else:
        raise ValueError(f"unsupported operator {op}")
    if round_to is not None:
        expr = F.round(expr, round_to)
    return df.withColumn(name, expr)


# PRJ-10 -------------------------------------------------------------------
def mask_columns(df: DataFrame, columns: Iterable[str], mask_char: str = "*", preserve_length: bool = True) -> DataFrame:
    out = {}
    for c in columns:
        if c not in df.columns:
            continue
        if preserve_length:
            out[c] = F.regexp_replace(F.col(c).cast("string"), r"(?s).", mask_char)
        else:
            out[c] = F.when(F.col(c).isNotNull(), F.lit(mask_char * 8))
    return df.withColumns(out) if out else df


# PRJ-11 -------------------------------------------------------------------
def derive_regex(df: DataFrame, source: str, pattern: str, target: str) -> DataFrame:
    """First capture group; no match -> null, a real empty capture stays ''."""
    s = F.col(source).cast("string")
    return df.withColumn(target, F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1)))


# PRJ-12 -------------------------------------------------------------------
MAP_LITERAL_LIMIT = 10_000


def derive_lookup(df: DataFrame, source: str, mapping: Mapping[Any, Any] | DataFrame, target: str,
                  key: str = "key", value: str = "value") -> DataFrame:
    """Lookup table; missing -> null.

    A Python dict of bounded size becomes a literal map (no join at all).  A
    lookup DataFrame is joined; Spark broadcasts it where its measured size allows.
    """
    if isinstance(mapping, Mapping):
        if len(mapping) > MAP_LITERAL_LIMIT:
            spark = df.sparkSession
            mapping = spark.createDataFrame([(k, v) for k, v in mapping.items()], [key, value])
        else:
            m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
            return df.withColumn(target, F.try_element_at(m, F.col(source)))
    lk = mapping.select(F.col(key).alias("__lk"), F.col(value).alias(target))
    lk = lk.dropDuplicates(["__lk"])
    return df.join(lk, F.col(source) == F.col("__lk"), "left").drop("__lk")


# PRJ-13 -------------------------------------------------------------------
def resolve_alias(df: DataFrame, column: str, canonical: Iterable[str], aliases: Mapping[str, str],
                  target: str | None = None) -> DataFrame:
    """Value if canonical, else alias map, else null."""
    canonical = list(canonical)
    c = F.col(column)
    amap = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))]) if aliases else None
    alias_val = F.try_element_at(amap, c) if amap is not None else F.lit(None).cast("string")
    return df.withColumn(target or column, F.coalesce(F.when(c.isin(canonical), c), alias_val))


# PRJ-14 -------------------------------------------------------------------
def normalize_column_name(name: str) -> str:
    n = name.lower().replace(" ", "_")
    return n.replace("imagecolumn", "imcol").replace("imagerow", "imrow")


def normalize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_column_name(c) for c in df.columns])


# PRJ-16 / PRJ-17 ----------------------------------------------------------
def format_value(c: Column, kind: str | None, currency: str = "USD", decimals: int | None = None) -> Column:
    """currency / percentage / uppercase / lowercase / title; non-numeric input passes through."""
    if kind is None:
        return c
    s = c.cast("string")
    num = s.try_cast("double")
    if kind == "currency":
        d = 2 if decimals is None else decimals
        sym = CURRENCY_SYMBOLS.get(currency, "$")
        return F.when(num.isNull(), s).otherwise(F.concat(F.lit(sym), F.format_number(num, d)))
    if kind == "percentage":
        d = 1 if decimals is None else decimals
        return F.when(num.isNull(), s).otherwise(F.concat(F.regexp_replace(F.format_number(num, d), ",", ""), F.lit("%")))
    if kind == "uppercase":
        return F.upper(s)
    if kind == "lowercase":
        return F.lower(s)
    if kind == "title":  # a capital after anything that is no letter
        runs = F.regexp_extract_all(s, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
        return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")
    return c


def kpi_text(value: Column, fmt: str = "%.2f") -> Column:
    return F.format_string(fmt, value)


# PRJ-15 -------------------------------------------------------------------
def mapped_record(df: DataFrame, mappings: Sequence[Mapping[str, Any]], keep_all: bool = True) -> DataFrame:
    """All input columns (NaN -> null) plus mapped outputs ``{target, source, default, transform}``."""
    cols = []
    if keep_all:
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
            else:
                cols.append(F.col(f.name))
    for m in mappings:
        src = m.get("source")
        val = format_value(F.col(src), m.get("transform"), m.get("currency", "USD")) if src in df.columns else F.lit(None)
        if m.get("default") is not None:
            val = F.coalesce(val.cast("string"), F.lit(str(m["default"])))
        cols.append(val.alias(m["target"]))
    return df.select(*cols)


# PRJ-18 -------------------------------------------------------------------
def iso_utc(c: Column, source_tz: str | None = None) -> Column:
    """Timestamp -> ISO-8601 UTC text with seconds precision and ``Z`` suffix.

    Naive timestamps are taken as UTC (or as ``source_tz`` when given)."""
    ts = c.cast("timestamp_ntz") if source_tz is None else F.to_utc_timestamp(c.cast("timestamp_ntz"), source_tz)
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sanitize_regex_group_names(pattern: str) -> tuple[str, list[str]]:
    """Python ``(?P<name>..)`` -> numbered groups (Java rejects ``_`` in names).

    Returns the rewritten pattern and the group names in order."""
    names: list[str] = []

    def repl(m):
        names.append(m.group(1))
        return "("

    return re.sub(r"\(\?P<([A-Za-z_][A-Za-z0-9_]*)>", repl, pattern), names


# OPT-08 -------------------------------------------------------------------------
def apply_output_options(df: DataFrame, nan_replacement: Any = None, string_strip: bool = False,
                         string_case: str | None = None, max_columns: int | None = None,
                         max_rows: int | None = None) -> DataFrame:
    """Profile output keys: fill nulls/NaN in numeric columns, strip / case strings,
    and enforce column and row limits (a limit violation raises; rows are counted
    with a bounded ``limit(max_rows + 1)`` probe, never truncated silently)."""
    if max_columns is not None and len(df.columns) > max_columns:
        raise ValueError(f"{len(df.columns)} columns exceed the limit of {max_columns}")
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if nan_replacement is not None and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.coalesce(F.nanvl(c, F.lit(None).cast(f.dataType)), F.lit(nan_replacement).cast(f.dataType))
        elif nan_replacement is not None and isinstance(f.dataType, T.NumericType):
            c = F.coalesce(c, F.lit(nan_replacement).cast(f.dataType))
        if isinstance(f.dataType, T.StringType):
            if string_strip:
                c = F.trim(c)
            if string_case == "upper":
                c = F.upper(c)
            elif string_case == "lower":
                c = F.lower(c)
            elif string_case == "title":
                c = F.initcap(c)
        cols.append(c.alias(f.name))
    out = df.select(*cols)
    if max_rows is not None and out.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"output exceeds the limit of {max_rows} rows")
    return out
