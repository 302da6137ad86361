"""Context columns per file / record (CTX-01..08).

Every context field is ONE column expression:
``coalesce(override, json path value, regex capture on the file name, default)``
-- no UDF, no per-file loop.  Python named groups are rewritten to numbered
groups because Java rejects ``_`` in group names.  Context is attached with a
join on ``file_path`` (per-file values, never one merged dictionary); the
context table has one row per file; Spark broadcasts it where its measured size allows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.transforms import sanitize_regex_group_names


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def _scope_col(scope: str, path_col: str) -> Column:
    p = F.col(path_col)
    if scope == "filename":
        return file_name(p)
    if scope == "path":
        return F.regexp_replace(p, r"[/\\][^/\\]*$", "")
    return p  # full_path


def regex_capture(text: Column, pattern: str, group: str | int = 1, transform: str | None = None) -> Column:
    """First match of ``pattern``; named or numbered group; '' -> null;
    optional transform upper/lower/strip/parse_date (unparsable date keeps text)."""
    pat, names = sanitize_regex_group_names(pattern)
    idx = (names.index(group) + 1) if isinstance(group, str) and group in names else (group if isinstance(group, int) else 1)
    v = F.nullif(F.regexp_extract(text, pat, idx), F.lit(""))
    if transform == "upper":
        v = F.upper(v)
    elif transform == "lower":
        v = F.lower(v)
    elif transform == "strip":
        v = F.trim(v)
    elif transform == "parse_date":
        parsed = F.coalesce(F.try_to_timestamp(v, F.lit("yyyyMMdd")), F.try_to_timestamp(v, F.lit("yyyy-MM-dd")))
        v = F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), v)
    return v


def context_field(field: str, *, path_col: str = "file_path", doc_col: str | None = "doc",
                  json_path: str | None = None, regex: Mapping[str, Any] | None = None, default: Any = None,
                  overrides: Mapping[str, Any] | None = None, allowed_overrides: Sequence[str] | None = None) -> Column:
    """CTX-01/02: override > JSON path > file-name regex > default (first non-null wins).
    An empty ``allowed_overrides`` list allows every override."""
    parts: list[Column] = []
    if overrides and field in overrides and (not allowed_overrides or field in allowed_overrides):
        parts.append(F.lit(overrides[field]).cast("string"))
    if json_path and doc_col:
        parts.append(F.try_variant_get(F.col(doc_col), json_path if json_path.startswith("$") else "$." + json_path,
                                       "string"))
    if regex:
        parts.append(regex_capture(_scope_col(regex.get("scope", "filename"), path_col), regex["pattern"],
                                   regex.get("group", 1), regex.get("transform")))
    if default is not None:
        parts.append(F.lit(default).cast("string"))
    if not parts:
        return F.lit(None).cast("string").alias(field)
    return F.coalesce(*parts).alias(field)


def file_context(docs: DataFrame, fields: Mapping[str, Mapping[str, Any]], path_col: str = "file_path",
                 doc_col: str = "doc", overrides: Mapping[str, Any] | None = None,
                 allowed_overrides: Sequence[str] | None = None) -> DataFrame:
    """One row per file with every configured context field."""
    cols = [context_field(name, path_col=path_col, doc_col=doc_col if doc_col in docs.columns else None,
                          json_path=spec.get("json_path"), regex=spec.get("regex"), default=spec.get("default"),
                          overrides=overrides, allowed_overrides=allowed_overrides)
            for name, spec in fields.items()]
    return docs.select(F.col(path_col), *cols)


# CTX-03 ---------------------------------------------------------------------------------
def required_pattern_policy(ctx: DataFrame, required: Sequence[str], policy: str = "warn",
                            path_col: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """Files missing a required context value: ``warn`` -> warning rows, ``error``
    -> raise, ``skip_file`` -> those files are removed.  Returns (context, warnings)."""
    missing = F.lit(False)
    for r in required:
        missing = missing | F.col(r).isNull()
    bad = ctx.filter(missing)
    warnings = bad.select(path_col, F.lit(f"missing required context {list(required)}").alias("message"),
                          F.lit(policy).alias("policy"))
    if policy == "error":
        first = bad.select(path_col).limit(1).collect()
        if first:
            raise ValueError(f"required context missing for {first[0][0]}")
    if policy == "skip_file":
        return ctx.filter(~missing), warnings
    return ctx, warnings


# CTX-04 / 05 --------------------------------------------------------------------------------
def run_context(docs: DataFrame, key_map: Mapping[str, str], path_col: str = "file_path",
                doc_col: str = "doc") -> DataFrame:
    """Run-level context from ``{target: $.path}`` per file."""
    return docs.select(F.col(path_col), *[F.try_variant_get(F.col(doc_col), p, "string").alias(t)
                                          for t, p in key_map.items()])


def image_context(docs: DataFrame, key_map: Mapping[str, str], images_path: str = "$.images",
                  path_col: str = "file_path", doc_col: str = "doc") -> DataFrame:
    """One row per image: key map on the element, then on its ``metadata``;
    image_id = coalesce(image_id, metadata.image_name)."""
    el = docs.select(F.col(path_col), F.explode(F.try_variant_get(F.col(doc_col), images_path, "array<variant>"))
                     .alias("__img"))
    def get(p: str) -> Column:
        rel = p[2:] if p.startswith("$.") else p.lstrip("$")
        return F.coalesce(F.try_variant_get(F.col("__img"), "$." + rel, "string"),
                          F.try_variant_get(F.col("__img"), "$.metadata." + rel, "string"))
    image_id = F.coalesce(get("$.image_id"), get("$.image_name")).alias("image_id")
    return el.select(F.col(path_col), image_id, *[get(p).alias(t) for t, p in key_map.items()])


# CTX-06 / 07 / 08 ---------------------------------------------------------------------------
def attach_context(df: DataFrame, ctx: DataFrame, on: Sequence[str] | str = "file_path",
                   keys: Sequence[str] | None = None, include: bool = True) -> DataFrame:
    """Add context columns by a left join on ``on``; never overwrites an existing
    column; optional key subset; ``include=False`` is a no-op (CTX-08 toggle)."""
    if not include:
        return df
    on = [on] if isinstance(on, str) else list(on)
    wanted = [c for c in ctx.columns if c not in on and (keys is None or c in keys) and c not in df.columns]
    if not wanted:
        return df
    small = ctx.select(*on, *wanted).dropDuplicates(on)
    return df.join(small, on, "left")


def python_pattern_to_java(pattern: str) -> str:
    """Named groups ``(?P<x>..)`` -> numbered groups; ``(?P=x)`` back-references -> ``\\n``."""
    pat, names = sanitize_regex_group_names(pattern)
    return re.sub(r"\(\?P=([A-Za-z_][A-Za-z0-9_]*)\)", lambda m: "\\" + str(names.index(m.group(1)) + 1), pat)
