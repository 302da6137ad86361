"""Profiles: loading, checking and running them (EXT-07, EXT-09, EXT-10, FLT-10).

A profile (YAML or dict) says which files to read, which context fields and tables
to extract, and how to clean, validate and write them.  Two layouts are read:

* the contract's (``meta``, ``datasource``, ``population``, ``context_defaults``,
  ``contexts`` as a list, ``levels`` of tables, ``normalization``, ``outputs``, ...);
* this library's flat one (``id``, ``tables``, ``contexts`` as a mapping, ...).

Both become one :class:`Profile`; a key that neither knows raises.  The runner
composes the library's operators into one lazy plan per table over ALL files; the
eager points are limits that the profile sets, discovery and validation
aggregates, and the writes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import context as CT
from quarry.operators import extract as E
from quarry.operators import filters as FL
from quarry.operators import joins as J
from quarry.operators import quality as Q
from quarry.operators import transforms as X
from quarry.operators.aggregates import config_groupby
from quarry.sources.readers import discover_files, file_predicate

ON_VALIDATION_FAIL = ("continue", "stop", "quarantine")


@dataclass
class Profile:
    id: str
    title: str = ""
    tables: list[dict] = field(default_factory=list)
    contexts: dict[str, dict] = field(default_factory=dict)
    image_contexts: list[dict] = field(default_factory=list)
    #: Context columns that are times, and their strptime formats ("": ISO 8601).
    time_fields: dict[str, str] = field(default_factory=dict)
    file_filter: dict | None = None
    population: dict | None = None
    validation: dict = field(default_factory=dict)
    normalization: dict = field(default_factory=dict)
    transforms: list[dict] = field(default_factory=list)
    row_filters: list[dict] = field(default_factory=list)
    type_coercion: list[dict] = field(default_factory=list)
    calculated_columns: list[dict] = field(default_factory=list)
    column_renames: dict[str, str] = field(default_factory=dict)
    schema_rules: dict = field(default_factory=dict)
    row_rules: list[dict] = field(default_factory=list)
    aggregate_rules: list[dict] = field(default_factory=list)
    on_validation_fail: str = "continue"
    quarantine_table: str = "validation_failures"
    outputs: dict = field(default_factory=dict)
    #: Limits apply only where the profile sets them: max_files, max_file_mb, max_total_gb, max_rows, max_columns, max_tables_per_level.
    limits: dict = field(default_factory=dict)
    required_context: list[str] = field(default_factory=list)
    required_policy: str = "warn"
    overrides: dict = field(default_factory=dict)
    allowed_overrides: list[str] = field(default_factory=list)
    mask_columns: list[str] = field(default_factory=list)
    info: dict = field(default_factory=dict)


# ---------------------------------------------------------------- loading
#: Contract layout: sections and what becomes of the keys in them (None: kept in ``info``).
_CONTRACT_ONLY = {"meta", "datasource", "levels", "context_defaults", "ui", "governance", "schema_version", "version"}
_LIMIT_NAMES = {"max_files_per_run": "max_files", "max_file_size_mb": "max_file_mb", "max_total_size_gb": "max_total_gb", "max_rows_output": "max_rows",
                "max_tables_per_level": "max_tables_per_level", "max_columns_per_table": "max_columns"}
_TABLE_KEYS = {"id", "label", "description", "select", "level", "apply_context", "stable_columns", "stable_columns_mode", "stable_columns_subset",
               "validation_constraints", "column_transforms"}
_SECTION_KEYS = {
    "meta": {"profile_id", "id", "title", "description", "created_by", "created_at", "modified_at", "revision", "hash", "owner", "classification", "domain", "tags"},
    "datasource": {"id", "label", "format", "filters", "options"},
    "population": {"default_strategy", "include_populations", "strategies", "strategy", "config"},
    "context_defaults": {"defaults", "regex_patterns", "content_patterns", "allow_user_override"},
    "normalization": {"nan_values", "units_policy", "unit_mappings", "numeric_coercion", "nan_replacement", "numeric_errors", "string_strip", "string_case", "column_units", "units"},
    "outputs": {"defaults", "optional_outputs", "long_form_optional", "aggregations", "joins", "ui"},
    "governance": {"access", "audit", "compliance", "limits"},
}


def _read(source: str | Mapping[str, Any]) -> dict[str, Any]:
    if isinstance(source, Mapping):
        return dict(source)
    import yaml

    if os.path.isfile(source):
        with open(source, encoding="utf-8") as f:
            source = f.read()
    return yaml.safe_load(source)


def _json_path(base: str, path: str) -> str:
    """A key map's path: absolute, or below a base path."""
    return path if path.startswith("$.") and base in ("", "$") else f"{base}.{path.removeprefix('$').removeprefix('.')}"


def _contract_contexts(raw: Mapping[str, Any]) -> dict[str, Any]:
    """Context fields of the contract layout: by priority JSON path, file-name pattern, default."""
    given = raw.get("context_defaults") or {}
    specs: dict[str, dict] = {name: {"default": value} for name, value in (given.get("defaults") or {}).items()}
    required, policies = [], set()
    for p in given.get("regex_patterns") or []:
        specs.setdefault(p["field"], {})["regex"] = {"pattern": p["pattern"], "group": p["field"], "scope": p.get("scope", "filename"), "transform": p.get("transform")}
    for p in given.get("content_patterns") or []:
        spec = specs.setdefault(p["field"], {})
        spec["json_path"] = p["path"]
        if p.get("default") is not None:
            spec.setdefault("default", p["default"])
    for p in [*(given.get("regex_patterns") or []), *(given.get("content_patterns") or [])]:
        if p.get("required"):
            required.append(p["field"])
            policies.add(p.get("on_fail", "warn"))
    images, times = [], {}
    for c in raw.get("contexts") or []:
        times |= c.get("time_fields") or {}
        if c.get("level") == "image":
            images.append({"path": (c.get("paths") or ["$.images[*]"])[0], "key_map": dict(c.get("key_map") or {})})
        else:
            for name, path in (c.get("key_map") or {}).items():
                specs.setdefault(name, {})["json_path"] = path
    strictest = next((p for p in ("error", "skip_file", "warn") if p in policies), "warn")
    return {"contexts": specs, "image_contexts": images, "time_fields": times, "required_context": list(dict.fromkeys(required)), "required_policy": strictest,
            "allowed_overrides": list(given.get("allow_user_override") or [])}


def _from_contract(raw: Mapping[str, Any]) -> dict[str, Any]:
    meta, source, governance = raw.get("meta") or {}, raw.get("datasource") or {}, raw.get("governance") or {}
    out = {k: v for k, v in raw.items() if k not in _CONTRACT_ONLY | {"contexts", "population", "normalization", "overrides"}}
    out |= {"id": meta.get("profile_id") or meta.get("id"), "title": meta.get("title", "")} | _contract_contexts(raw)
    if source.get("filters"):
        out["file_filter"] = _file_filter(source["filters"])
    population = raw.get("population") or {}
    name = population.get("default_strategy", "all")
    out["population"] = {"strategy": name, "config": (population.get("strategies") or {}).get(name) or {}}
    out["normalization"] = {"numeric_coercion": True} | (raw.get("normalization") or {})
    tables = []
    for level in raw.get("levels") or []:
        for t in level.get("tables") or []:
            tables.append({"stable_columns_subset": True, **t, "level": level.get("name"), "apply_context": level.get("apply_context", "")})
    out["tables"] = tables
    limits = governance.get("limits") or {}
    out["limits"] = {_LIMIT_NAMES[k]: v for k, v in limits.items() if k in _LIMIT_NAMES}
    out["mask_columns"] = list((governance.get("compliance") or {}).get("mask_in_preview") or [])
    allow = ((raw.get("overrides") or {}).get("allow")) or {}
    out["allowed_overrides"] += [k for k, v in allow.items() if v and k not in out["allowed_overrides"]]
    out["info"] = {k: raw[k] for k in ("schema_version", "version", "meta", "datasource", "ui", "governance", "population", "overrides") if k in raw}
    return out


def _file_filter(node: Mapping[str, Any]) -> dict[str, Any]:
    """A datasource filter tree in the form of :func:`file_predicate`."""
    if node.get("type") == "predicate":
        return {"field": node["field"], "operator": node["op"], "value": node.get("value"), "case_sensitive": node.get("case", "insensitive") == "sensitive"}
    return {str(node.get("op", "and")).lower(): [_file_filter(c) for c in node.get("children") or []]}


def _constraints(rules: Any) -> dict[str, dict]:
    """``[{column, type, ...}]`` or ``{column: {...}}`` as the latter."""
    if isinstance(rules, Mapping):
        return dict(rules)
    kinds: dict[str, Callable[[Mapping], dict]] = {"range": lambda r: {k: r[k] for k in ("min", "max") if k in r}, "not_null": lambda r: {"not_null": True},
                                                   "regex": lambda r: {"regex": r["pattern"]}}
    out: dict[str, dict] = {}
    for r in rules or []:
        if r.get("type") not in kinds:
            raise ValueError(f"unknown constraint type {r.get('type')!r}")
        out.setdefault(r["column"], {}).update(kinds[r["type"]](r))
    return out


def check_profile(p: Mapping[str, Any]) -> list[str]:
    """EXT-09: unknown keys, ids/titles, patterns, table configurations, outputs referring to known tables."""
    contract = bool(_CONTRACT_ONLY & set(p)) and "tables" not in p
    known = {f.name for f in fields(Profile)} | (_CONTRACT_ONLY | {"id"} if contract else {"meta", "schema_version", "version"})
    errs = [f"unknown key {k}" for k in p if k not in known]
    for section, keys in _SECTION_KEYS.items():
        if isinstance(p.get(section), Mapping):
            errs += [f"unknown key {section}.{k}" for k in p[section] if k not in keys]
    flat = _from_contract(p) if contract else p
    if not (flat.get("id") or (p.get("meta") or {}).get("id")):
        errs.append("profile id missing")
    ids = set()
    for t in flat.get("tables") or []:
        if not t.get("id"):
            errs.append("table without id")
        if t.get("id") in ids and t.get("level") is None:
            errs.append(f"duplicate table id {t.get('id')}")
        ids.add(t.get("id"))
        errs += [f"{t.get('id')}: unknown key {k}" for k in t if k not in _TABLE_KEYS]
        errs += [f"{t.get('id')}: {e}" for e in E.validate_config(t.get("select", {}))]
    for name, spec in (flat.get("contexts") or {}).items():
        rx = (spec.get("regex") or {}).get("pattern")
        if rx:
            try:
                re.compile(rx)
            except re.error as e:
                errs.append(f"context {name}: bad regex {e}")
    if flat.get("on_validation_fail", "continue") not in ON_VALIDATION_FAIL:
        errs.append(f"on_validation_fail must be one of {', '.join(ON_VALIDATION_FAIL)}")
    outputs = flat.get("outputs") or {}
    made = ids | {a.get("output_table") or a.get("id") for a in outputs.get("aggregations") or []}
    for agg in outputs.get("aggregations") or []:
        if (agg.get("table") or agg.get("from_table")) not in ids:
            errs.append(f"aggregation refers to unknown table {agg.get('table') or agg.get('from_table')}")
    for o in [*(outputs.get("defaults") or []), *(outputs.get("optional_outputs") or outputs.get("long_form_optional") or [])]:
        errs += [f"output {o.get('id')} refers to unknown table {t}" for t in o.get("from_tables") or [] if t not in made]
    return errs


def load_profile(source: str | Mapping[str, Any]) -> Profile:
    """From a YAML file path, YAML text or a dict; raises on configuration errors."""
    raw = _read(source)
    errs = check_profile(raw)
    if errs:
        raise ValueError("; ".join(errs))
    if _CONTRACT_ONLY & set(raw) and "tables" not in raw:
        flat = _from_contract(raw)
    else:
        meta = raw.get("meta") or {}
        flat = {"id": meta.get("id"), "title": meta.get("title", "")} | {k: v for k, v in raw.items() if k not in ("meta", "schema_version", "version")}
    return Profile(**flat)


# ---------------------------------------------------------------- running
def governance_check(files: DataFrame, limits: Mapping[str, Any]) -> list[str]:
    """EXT-10: the limits that are set, by one aggregate over the file listing."""
    row = files.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("mx"), F.sum("size").alias("tot")).first()
    v = []
    if limits.get("max_files") is not None and row["n"] > limits["max_files"]:
        v.append(f"{row['n']} files exceed max_files")
    if limits.get("max_file_mb") is not None and (row["mx"] or 0) > limits["max_file_mb"] * 1024 * 1024:
        v.append("a file exceeds max_file_mb")
    if limits.get("max_total_gb") is not None and (row["tot"] or 0) > limits["max_total_gb"] * 1024 ** 3:
        v.append("total size exceeds max_total_gb")
    return v


def _normalized(df: DataFrame, norm: Mapping[str, Any], row_filters: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Null markers, numeric coercion, row filters, units: in this order."""
    if norm.get("nan_values"):
        df = X.replace_null_markers(df, [str(v) for v in norm["nan_values"]])
    if norm.get("numeric_coercion"):
        clean = X.numeric_coercion_plan(df, None, 1e-12) if norm.get("numeric_errors") in ("raise", "ignore") else None
        if norm.get("numeric_errors") == "raise" and (bad := sorted(set(X.numeric_coercion_plan(df, None, 0.5)) - set(clean))):
            raise ValueError(f"cells that are no numbers in numeric columns: {', '.join(bad)}")
        df = X.auto_numeric_coercion(df) if clean is None else X.auto_numeric_coercion(df, clean, 1e-12) if clean else df
    df = FL.apply_row_filters(df, row_filters)
    if norm.get("units_policy") and norm.get("column_units"):
        df = X.apply_units_policy(df, norm["units_policy"], norm["column_units"], norm.get("units"))
    return df


def _transformed(df: DataFrame, prof: Profile, table: Mapping[str, Any]) -> DataFrame:
    """Column transforms, type coercion, calculated columns, renames, output options: in this order."""
    norm = prof.normalization or {}
    own = [t for t in prof.transforms if t.get("table", table["id"]) == table["id"]]
    df = X.column_transforms(df, [*own, *(table.get("column_transforms") or [])])
    df = X.coerce_types(df, prof.type_coercion)
    for c in prof.calculated_columns:
        needed = [x for x in (c["left"], c["right"]) if isinstance(x, str)]
        if all(x in df.columns for x in needed):  # one profile serves many tables
            df = X.calculated_column(df, c["name"], c["left"], c["op"], c["right"], c.get("round_to"))
    df = X.rename_columns(df, prof.column_renames)
    case = norm.get("string_case")
    return X.apply_output_options(df, norm.get("nan_replacement"), bool(norm.get("string_strip")), None if case == "preserve" else case,
                                  prof.limits.get("max_columns"), prof.limits.get("max_rows"))


def _rules(prof: Profile, table: Mapping[str, Any]) -> dict[str, Any]:
    """All validation of one table: the profile's, the flat layout's by table, and the table's own."""
    tv = (prof.validation or {}).get(table["id"], {})
    schema = {**prof.schema_rules, **(tv.get("schema_rules") or {})}
    return {"stable": table.get("stable_columns") or tv.get("stable_columns"),
            "mode": table.get("stable_columns_mode") or tv.get("mode", "warn"),
            "subset": table.get("stable_columns_subset", tv.get("subset", False)),
            "constraints": {**_constraints(tv.get("constraints")), **_constraints(table.get("validation_constraints"))},
            "schema": schema,
            "rows": [{"name": r.get("name", "unnamed"), "expr": r.get("expr") or r.get("expression"), "on_fail": r.get("on_fail", "warn")}
                     for r in [*prof.row_rules, *(tv.get("row_rules") or [])]],
            "aggregates": [*prof.aggregate_rules, *(tv.get("aggregate_rules") or [])]}


def _validated(df: DataFrame, name: str, rules: Mapping[str, Any]) -> tuple[list[DataFrame], list[dict]]:
    results, issues = [], []
    if rules["stable"]:
        issues = Q.stable_columns(df, rules["stable"], rules["mode"], rules["subset"], name)
    if rules["constraints"]:
        results.append(Q.value_constraints(df, rules["constraints"], name))
    schema = rules["schema"]
    if schema:
        results.append(Q.schema_rules(df, schema.get("required_columns", ()), schema.get("column_types"), schema.get("unique_columns", ()), name))
    if rules["rows"]:
        results.append(Q.row_rules(df, rules["rows"], name))
    if rules["aggregates"]:
        severity = {r.get("type"): "error" if r.get("on_fail") == "error" else "warning" for r in rules["aggregates"]}
        found = Q.aggregate_rules(df, rules["aggregates"], name)
        labels = F.create_map(*[F.lit(x) for kv in severity.items() for x in kv])
        results.append(found.select("table_name", "rule", "column_name", (~F.col("passed")).cast("bigint").alias("violations"),
                                    F.element_at(labels, F.col("rule")).alias("severity"), "passed"))
    return results, issues


def _row_checks(rules: Mapping[str, Any], df: DataFrame) -> dict[str, Any]:
    """Row-level predicates of the constraints and of the row rules that are errors, by name."""
    checks: dict[str, Any] = {}
    for column, rule in rules["constraints"].items():
        if column not in df.columns:
            continue
        c = F.col(column)
        parts = {"min": lambda v, c=c: c.isNull() | (c >= F.lit(v)), "max": lambda v, c=c: c.isNull() | (c <= F.lit(v)),
                 "not_null": lambda v, c=c: c.isNotNull() if v else F.lit(True), "regex": lambda v, c=c: c.isNull() | c.cast("string").rlike(v)}
        checks |= {f"{column}:{k}": parts[k](v) for k, v in rule.items() if v is not None}
    return checks | {r["name"]: r["expr"] for r in rules["rows"] if r["on_fail"] == "error"}


def _with_images(df: DataFrame, images: Sequence[DataFrame]) -> DataFrame:
    """Image context by file and image id, where the table has one."""
    for ctx in images if "image_id" in df.columns else ():
        df = CT.attach_context(df, ctx, ["file_path", "image_id"])
    return df


def _timed(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Context columns as timestamps; what does not have the format becomes null."""
    known = {c: f for c, f in fields.items() if c in df.columns}
    return df.withColumns({c: F.try_to_timestamp(c, F.lit(X.strptime_to_java(f))) if f else F.try_to_timestamp(c) for c, f in known.items()}) if known else df


def _merged(tables: Sequence[Mapping[str, Any]]) -> dict[str, Any]:
    """Entries with one id (of several levels) as one: lists after each other, mappings united, else the first that is set."""
    out: dict[str, Any] = {}
    for t in tables:
        for k, v in t.items():
            if isinstance(v, list) and isinstance(out.get(k), list):
                out[k] = out[k] + [x for x in v if x not in out[k]]
            elif isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
                out[k] = {**v, **out[k]}
            elif out.get(k) is None:
                out[k] = v
    return out


def build_outputs(prof: Profile, tables: Mapping[str, DataFrame], with_run: Callable[[DataFrame], DataFrame], with_images: Callable[[DataFrame], DataFrame],
                  selected: Sequence[str] | None = None, include_context: bool | None = None, include_run_context: bool | None = None,
                  include_image_context: bool | None = None, added: Mapping[str, tuple[set[str], set[str]]] | None = None) -> dict[str, DataFrame]:
    """Aggregations, joins and named outputs of a profile.

    Named outputs unite their tables by column name.  All default outputs are built,
    and the optional ones that ``selected`` names.  Run and image context have a toggle each:
    the caller's ``include_run_context`` / ``include_image_context``, else ``include_context`` for both, else
    the output's own keys of these names, else both are there.  ``added`` names the run and the image columns that each
    table got before: an output without them leaves them out."""
    cfg, made = prof.outputs or {}, dict(tables)
    for agg in cfg.get("aggregations") or []:
        source = agg.get("table") or agg["from_table"]
        if source in made:
            made[agg.get("output_table") or agg.get("id") or f"{source}_agg"] = config_groupby(made[source], agg["group_by"], agg["aggregations"])
    for jn in cfg.get("joins") or []:
        left, right = jn.get("left") or jn.get("left_table"), jn.get("right") or jn.get("right_table")
        joined = J.output_join(made.get(left), made.get(right), jn["on"], jn.get("how", "left"))
        if joined is not None:
            made[jn.get("id", f"{left}_{right}")] = joined
    optional = cfg.get("optional_outputs") or cfg.get("long_form_optional") or []
    for o in [*(cfg.get("defaults") or []), *(o for o in optional if o["id"] in (selected or ()))]:
        sources = [t for t in o.get("from_tables") or [] if t in made]
        if not sources:
            continue
        kinds = (("include_run_context", include_run_context, with_run), ("include_image_context", include_image_context, with_images))
        wanted = [next(c for c in (own, include_context, o.get(key), o.get("include_context"), True) if c is not None) for key, own, _ in kinds]
        out = J.union_diagonal([made[t].drop(*(c for show, columns in zip(wanted, (added or {}).get(t, ())) if not show for c in columns)) for t in sources])
        for show, (_, _, attach) in zip(wanted, kinds):
            out = attach(out) if show else out
        made[o["id"]] = out
    return made


def run_profile(spark: SparkSession, profile: Profile | Mapping[str, Any] | str, root: str, output_dir: str | None = None,
                selected_outputs: Sequence[str] | None = None, include_context: bool | None = None, include_run_context: bool | None = None,
                include_image_context: bool | None = None) -> dict[str, Any]:
    """Extract -> context -> population -> validate -> normalise -> transform -> outputs.

    Returns tables, file_context, validation, warnings, context_warnings, bad_files and previews (tables with masked columns).

    ``on_validation_fail``: ``continue`` reports; ``stop`` raises if a table has errors;
    ``quarantine`` moves the rows that fail a constraint or an error rule to the quarantine table (with
    ``__table_id__`` and ``failed_rules``), which is written with the others."""
    prof = profile if isinstance(profile, Profile) else load_profile(profile)
    files = discover_files(spark, root, glob="*.json")
    if prof.file_filter:
        files = files.filter(file_predicate(prof.file_filter))
    violations = governance_check(files, prof.limits) if prof.limits else []
    by_level: dict[Any, int] = {}
    for t in prof.tables:
        by_level[t.get("level")] = by_level.get(t.get("level"), 0) + 1
    most = prof.limits.get("max_tables_per_level")
    violations += [f"level {level} has {n} tables" for level, n in by_level.items() if most is not None and n > most]
    if violations:
        raise E.LimitExceeded("; ".join(violations))
    # the listing that Spark's own reader keeps on the driver
    paths = [r["full_path"] for r in files.select("full_path").collect()]
    if not paths:
        return {"tables": {}, "warnings": ["no files"], "file_context": None, "validation": None, "context_warnings": None, "bad_files": None, "previews": {}}
    docs, bad = E.read_documents(spark, paths)
    docs = docs.persist(StorageLevel.MEMORY_AND_DISK)
    ctx = CT.file_context(docs, prof.contexts, overrides=prof.overrides, allowed_overrides=prof.allowed_overrides) \
        if prof.contexts else docs.select("file_path")
    ctx, ctx_warn = CT.required_pattern_policy(ctx, prof.required_context, prof.required_policy) \
        if prof.required_context else (ctx, None)
    if prof.required_context and prof.required_policy == "skip_file":
        docs = docs.join(ctx.select("file_path"), "file_path", "left_semi")
    images = [_timed(CT.image_context(docs, c["key_map"], c["path"].split("[*]")[0]), prof.time_fields) for c in prof.image_contexts]
    ctx = _timed(ctx, prof.time_fields)
    specs = [{**t, "select": {**t["select"], **({"max_columns": prof.limits["max_columns"]} if "max_columns" in prof.limits else {})}} for t in prof.tables]
    tables, warnings = E.extract_tables(docs, specs)
    by_id = {i: _merged([t for t in prof.tables if t["id"] == i]) for i in dict.fromkeys(t["id"] for t in prof.tables)}
    results, quarantined, added = [], [], {}
    for name, df in list(tables.items()):
        table, rules = by_id[name], _rules(prof, by_id[name])
        own = set(df.columns)
        df = CT.attach_context(df, ctx, "file_path")
        of_run = set(df.columns) - own
        df = _with_images(df, images)
        added[name] = of_run, set(df.columns) - own - of_run
        if prof.population:
            df = FL.population(df, prof.population.get("strategy", "all"), prof.population.get("config"))
        found, issues = _validated(df, name, rules)
        results += found
        warnings += [{"table_id": i["table_name"], "message": f"{i['rule']}: {', '.join(i['columns'])}", "severity": i["severity"]} for i in issues]
        if prof.on_validation_fail == "quarantine" and (checks := _row_checks(rules, df)):
            df, failed = Q.quarantine_split(df, checks)
            quarantined.append(failed.withColumn("__table_id__", F.lit(name)))
        tables[name] = _transformed(_normalized(df, prof.normalization or {}, prof.row_filters), prof, table)
    validation = Q.validation_summary(results, expected_tables=[t["id"] for t in prof.tables]) if results else None
    if prof.on_validation_fail == "stop" and validation is not None:
        wrong = validation.where("NOT valid").select("table_name", "errors").collect()  # a row a table
        if wrong:
            raise ValueError("validation failed: " + ", ".join(f"{r['table_name']} has {r['errors']} errors" for r in wrong))
    with_run = lambda df: CT.attach_context(df, ctx, "file_path") if "file_path" in df.columns else df
    tables = build_outputs(prof, tables, with_run, lambda df: _with_images(df, images), selected_outputs, include_context, include_run_context, include_image_context, added)
    if quarantined:
        tables[prof.quarantine_table] = J.union_diagonal(quarantined)
    if output_dir:
        from quarry.sources.sinks import write_tables

        write_tables(tables, output_dir)
    previews = {name: X.mask_columns(df, prof.mask_columns) for name, df in tables.items()} if prof.mask_columns else dict(tables)
    return {"tables": tables, "file_context": ctx, "validation": validation, "warnings": warnings,
            "context_warnings": ctx_warn, "bad_files": bad, "previews": previews}
