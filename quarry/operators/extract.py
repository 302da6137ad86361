"""Profile-driven extraction of flat tables from JSON documents (EXT-01..10).

Documents are parsed once into a ``VARIANT`` column (``try_parse_json``, so a
malformed file yields null instead of failing the job).  A JSONPath is split
at each ``[*]`` into ``posexplode`` steps over ``array<variant>``; typed values
come from ``try_variant_get``.  A table's columns are found by one aggregate
over the documents (``schema_of_variant_agg``; a row a column at most) unless the
configuration gives their types; then one ``select`` over the same scan extracts
all columns, however many header sets or nesting levels there are.  Values of
different types under one name become text.  There is no limit on columns unless
the user sets one, and exceeding that stops the run (:class:`LimitExceeded`).
"""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.arrays import bound

log = logging.getLogger(__name__)

DATA_KEYS = ("data", "values", "rows", "bins", "items")
HEADER_KEYS = ("headers", "columns")
HOWS = ("left", "right", "inner", "outer")
STRATEGIES = ("flat_object", "headers_data", "array_of_objects", "repeat_over", "unpivot", "join")


class LimitExceeded(ValueError):
    """A limit that the user set is exceeded: the run stops."""


# paths ----------------------------------------------------------------------------
def _norm_path(path: str | None) -> str:
    if not path or path == "$":
        return "$"
    p = path if path.startswith("$") else "$." + path.lstrip(".")
    return p


def split_path(path: str | None) -> list[str]:
    """``$.a[*].b[*]`` -> ``['$.a', '$.b', '$']`` : explode after every segment but the last."""
    p = _norm_path(path)
    parts = p.split("[*]")
    out = [parts[0]]
    for rest in parts[1:]:
        out.append("$" + rest if rest else "$")
    return out


def strip_wildcard(path: str) -> str:
    """Remove a trailing ``[*]`` suffix (the suffix, not its characters)."""
    return path[:-3] if path.endswith("[*]") else path


def at(v: Column, path: str) -> Column:
    p = _norm_path(path)
    return v if p == "$" else F.try_variant_get(v, p, "variant")


def explode_path(df: DataFrame, vcol: str, path: str, out: str = "__e", pos: str | None = None) -> DataFrame:
    """Rows for every element reached by ``path`` (one explode per ``[*]``).
    The final segment is not exploded; the result column is a variant."""
    segs = split_path(path)
    cur = vcol
    for i, seg in enumerate(segs[:-1]):
        arr = F.try_variant_get(F.col(cur), seg, "array<variant>") if seg != "$" else \
            F.try_variant_get(F.col(cur), "$", "array<variant>")
        nxt = f"{out}_{i}"
        pcol = pos if (pos and i == len(segs) - 2) else f"{nxt}_pos"
        df = df.select("*", F.posexplode(arr).alias(pcol, nxt))
        cur = nxt
    return df.withColumn(out, at(F.col(cur), segs[-1]))


# types ------------------------------------------------------------------------------
_INT = ("BIGINT", "INT", "SMALLINT", "TINYINT")
_FLOAT = ("DECIMAL", "DOUBLE", "FLOAT")


def spark_type_for(variant_type: str | None) -> str:
    """Variant type name (from ``schema_of_variant_agg``) -> Spark type for extraction."""
    t = (variant_type or "VOID").upper()
    head = re.split(r"[<(]", t, maxsplit=1)[0].strip()
    if head in _INT:
        return "bigint"
    if head in _FLOAT:
        return "double"
    if head == "BOOLEAN":
        return "boolean"
    if head == "DATE":
        return "date"
    if head in ("TIMESTAMP", "TIMESTAMP_NTZ"):
        return "timestamp_ntz"
    if head == "OBJECT":
        return "object"
    if head == "ARRAY":
        return "array"
    return "string"


def typed(v: Column, t: str) -> Column:
    """Typed value of a variant; objects/arrays become compact JSON text."""
    if t in ("object", "array"):
        return F.to_json(v)
    if t == "string":
        # a JSON string comes back unquoted; anything else as its JSON text
        return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    return F.try_variant_get(v, "$", t)


def _as_ddl(variant_type: str) -> str:
    """A variant's type name as Spark DDL (quoted field names stay as they are)."""
    return re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], variant_type)


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.StructType):
        return "object"
    return spark_type_for(t.simpleString())


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def discover_object(df: DataFrame, vcol: str, max_columns: int | None = None) -> T.StructType:
    """All keys of the objects in a variant column with their merged types, nested ones too: one aggregate, one row."""
    found = df.agg(F.schema_of_variant_agg(F.when(is_object(F.col(vcol)), F.col(vcol))).alias("t")).first()["t"]
    struct = T.DataType.fromDDL(_as_ddl(found)) if (found or "").startswith("OBJECT<") else T.StructType([])
    if max_columns is not None and len(struct.fields) > max_columns:
        raise LimitExceeded(f"{len(struct.fields)} keys exceed the limit of {max_columns}")
    return struct


def discover_fields(df: DataFrame, vcol: str, max_columns: int | None = None) -> list[tuple[str, str]]:
    """Keys of the objects in a variant column and the kind of their values, by key."""
    return sorted((f.name, _kind(f.dataType)) for f in discover_object(df, vcol, max_columns).fields)


def _type_name(v: Column) -> Column:
    """A variant's type name without its parts: BIGINT, DECIMAL, OBJECT, ..."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def _merged_kind(names: set[str | None]) -> str:
    """One kind for all the types under a name; what does not go together is text."""
    kinds = {spark_type_for(n) for n in names if n not in (None, "", "VOID")}
    return kinds.pop() if len(kinds) == 1 else "double" if kinds == {"bigint", "double"} else "string"


def distinct_names(names: Sequence[str], taken: Sequence[str] = ()) -> list[str]:
    """Column names that later steps can tell apart whatever their case: a name that an earlier one (or one ``taken``) has, but
    for case, gets the next free of ``_2``, ``_3``, ..."""
    used, out = {t.lower() for t in taken}, []
    wanted = {n.lower() for n in names}
    for n in names:
        new, k = n, 1
        while new.lower() in used or (k > 1 and new.lower() in wanted):
            k += 1
            new = f"{n}_{k}"
        used.add(new.lower())
        out.append(new)
    return out


def child(v: Column, key: str) -> Column:
    """The value under a key, whatever quotes the key has."""
    if '"' not in key and "\\" not in key:
        return F.try_variant_get(v, f'$["{key}"]', "variant")
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))


# EXT-01 ---------------------------------------------------------------------------------
def flat_object(docs: DataFrame, path: str = "$", flatten_nested: bool = True, flatten_separator: str = "_",
                doc_col: str = "doc", keep: Sequence[str] = ("file_path",), max_columns: int | None = None) -> DataFrame:
    """One row per document from the object at ``path``.  Keys that differ only in case
    are columns of their own (:func:`distinct_names`).  Nested objects become
    prefixed columns (or JSON text when ``flatten_nested`` is false); lists
    become JSON text.  Keys come out in sorted order (VARIANT sorts them)."""
    keep = [k for k in keep if k in docs.columns]
    base = docs.select(*keep, at(F.col(doc_col), path).alias("__o"))

    def columns(struct: T.StructType, v: Column, prefix: str):
        for f in struct.fields:
            name = f"{prefix}{flatten_separator}{f.name}" if prefix else f.name
            if isinstance(f.dataType, T.StructType) and flatten_nested:
                yield from columns(f.dataType, child(v, f.name), name)
            else:
                yield name, typed(child(v, f.name), _kind(f.dataType))

    found = list(columns(discover_object(base, "__o", max_columns), F.col("__o"), ""))
    return base.select(*keep, *(c.alias(n) for n, (_, c) in zip(distinct_names([n for n, _ in found], keep), found)))


# EXT-02 ---------------------------------------------------------------------------------
def _first_present(v: Column, keys: Sequence[str], typ: str) -> Column:
    plain = lambda k: '"' not in k and "\\" not in k
    return F.coalesce(*[F.try_variant_get(v, f'$["{k}"]', typ) if plain(k) else F.try_variant_get(child(v, k), "$", typ) for k in keys])


def _header_rows(docs: DataFrame, path: str, headers_key: str | None, data_key: str | None, infer_headers: bool,
                 default_headers: Sequence[str] | None, doc_col: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, __h (a block's headers), __row (null for a block without rows) and __c (the row's cells by header)."""
    blk = explode_path(docs.select(*keep, F.col(doc_col)), doc_col, path, "__blk").select(
        *keep, _first_present(F.col("__blk"), [headers_key] if headers_key else HEADER_KEYS, "array<string>").alias("__h"),
        _first_present(F.col("__blk"), [data_key] if data_key else DATA_KEYS, "array<variant>").alias("__rows"))
    headers = [F.col("__h")]
    if infer_headers:  # from a block whose first row is a list
        width = F.array_max(F.transform("__rows", lambda r: F.size(F.try_variant_get(r, "$", "array<variant>"))))
        first = F.try_variant_get(F.get("__rows", F.lit(0)), "$", "array<variant>")
        headers.append(F.when(first.isNotNull(), F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.concat(F.lit("col_"), i.cast("string")))))
    if default_headers:
        headers.append(F.array(*map(F.lit, default_headers)))
    # the condition within the value: a filter would be pushed down and read the headers once more
    block = F.filter(F.array(F.struct(F.coalesce(*headers).alias("h"), F.col("__rows").alias("r"))), lambda b: b["h"].isNotNull())
    rows = blk.select(*keep, F.explode(block).alias("__b")).select(*keep, F.col("__b.h").alias("__h"), F.explode_outer("__b.r").alias("__row"))
    r = F.col("__row")
    members = F.try_variant_get(r, "$", "map<string,variant>")
    cells = F.coalesce(F.try_variant_get(r, "$", "array<variant>"),  # a list: by position
                       F.when(members.isNotNull(), F.transform("__h", lambda h: F.try_element_at(members, h))),  # an object: by name
                       F.when(r.isNotNull(), F.array(r)))  # a scalar: the first cell
    return rows.withColumn("__c", cells)


def headers_data(docs: DataFrame, path: str = "$", headers_key: str | None = None, data_key: str | None = None,
                 infer_headers: bool = False, default_headers: Sequence[str] | None = None,
                 doc_col: str = "doc", keep: Sequence[str] = ("file_path",), types: Mapping[str, str] | None = None,
                 max_columns: int | None = None) -> DataFrame:
    """A header array plus rows -> table.  Short rows are padded with null, long
    rows cut to the headers; object rows go by name, a scalar row is one cell.
    Headers: the block's own, else ``col_0..`` (``infer_headers``), else
    ``default_headers``.  Blocks may differ in their headers: the table has all of
    them, in the order of their places.  Of a name that a block repeats the last
    place counts.  ``types`` (name -> Spark type) replaces the discovery.

    ``keep`` columns of type VARIANT get their type in the same discovery."""
    keep = [k for k in keep if k in docs.columns]
    rows = _header_rows(docs, path, headers_key, data_key, infer_headers, default_headers, doc_col, keep)
    variants = [k for k in keep if isinstance(docs.schema[k].dataType, T.VariantType)]
    found: dict[tuple[bool, str], tuple[int, set[str]]] = {}
    if types is None or variants:
        # rows by their headers and their cells' type names: a hash aggregate, few groups as a rule
        heads = F.transform("__h", lambda h, i: _type_name(F.get("__c", i)))
        kept = F.array(*[_type_name(F.col(k)) for k in variants]).cast("array<string>")
        shapes = rows.groupBy("__h", heads.alias("__t"), kept.alias("__k")).agg(F.count(F.lit(1)).alias("n"))
        entry = F.concat(F.transform("__h", lambda h, i: F.struct(F.lit(False).alias("kept"), h.alias("name"), i.alias("place"), F.get("__t", i).alias("t"))),
                         F.transform(F.array(*map(F.lit, variants)).cast("array<string>"), lambda k, i: F.struct(F.lit(True).alias("kept"), k.alias("name"), i.alias("place"), F.get("__k", i).alias("t"))))
        for r in shapes.select(F.explode(entry).alias("e")).groupBy("e.kept", "e.name", "e.t").agg(F.min("e.place").alias("place")).collect():  # a few rows a column
            place, names = found.setdefault((r["kept"], r["name"]), (r["place"], set()))
            names.add(r["t"])
            found[r["kept"], r["name"]] = (min(place, r["place"]), names)
    order = sorted(found.items(), key=lambda f: (f[1][0], f[0][1]))
    kept_kinds = {name: _merged_kind(names) for (kept, name), (_, names) in order if kept}
    kinds = dict(types) if types is not None else {name: _merged_kind(names) for (kept, name), (_, names) in order if not kept}
    if max_columns is not None and len(kinds) > max_columns:
        raise LimitExceeded(f"{len(kinds)} columns exceed the limit of {max_columns}")

    def cell(name: str) -> Column:
        back = F.array_position(F.reverse("__h"), F.lit(name))  # the last place of the name
        return F.get("__c", F.when(back > 0, F.size("__h") - back).cast("int"))

    own = [typed(F.col(k), kept_kinds.get(k, "string")).alias(k) if k in variants else F.col(k) for k in keep]
    cells = [(n, t) for n, t in kinds.items() if n not in keep]
    return rows.where("__row IS NOT NULL").select(*own, *(typed(cell(n), t).alias(new) for new, (n, t) in zip(distinct_names([n for n, _ in cells], keep), cells)))


# EXT-03 ---------------------------------------------------------------------------------
def array_of_objects(docs: DataFrame, path: str, fields: Sequence[str] | None = None, doc_col: str = "doc",
                     keep: Sequence[str] = ("file_path",), max_columns: int | None = None) -> DataFrame:
    """One row per array element; columns = union of keys (or ``fields``), missing -> null."""
    keep = [k for k in keep if k in docs.columns]
    el = _object_elements(docs, path, doc_col, keep)
    return _select_objects(el, discover_fields(el, "__o", max_columns), fields, keep)


def _object_elements(docs: DataFrame, path: str, doc_col: str, keep: Sequence[str]) -> DataFrame:
    p = _norm_path(path)
    p = p if p.endswith("[*]") else p + "[*]"
    return explode_path(docs.select(*keep, F.col(doc_col)), doc_col, p, "__o", pos="__pos")


def _select_objects(el: DataFrame, found: Sequence[tuple[str, str]], fields: Sequence[str] | None,
                    keep: Sequence[str]) -> DataFrame:
    if fields:
        tmap = dict(found)
        found = [(f, tmap.get(f)) for f in fields]
    return el.select(*keep, *(typed(child(F.col("__o"), k), t or "string").alias(n) for n, (k, t) in zip(distinct_names([k for k, _ in found], keep), found)))


# EXT-04 ---------------------------------------------------------------------------------
def repeat_over(docs: DataFrame, path: str, as_name: str, base: Mapping[str, Any],
                inject_fields: Mapping[str, str] | None = None, doc_col: str = "doc",
                keep: Sequence[str] = ("file_path",)) -> DataFrame:
    """Run a base strategy once per element of the array at ``path``; ``{as}``
    in the base path refers to the element; parent fields are injected."""
    keep = [k for k in keep if k in docs.columns]
    p = _norm_path(path)
    p = p if p.endswith("[*]") else p + "[*]"
    el = explode_path(docs.select(*keep, F.col(doc_col)), doc_col, p, "__item", pos="__item_pos")
    def of_element(q: str) -> str:
        """A path from the element: it is ``{as}``, or the array's path with ``{as}`` as the index."""
        for head in (f"{strip_wildcard(p)}[{{{as_name}}}]", f"{{{as_name}}}"):
            if q.startswith(head):
                return "$" + q[len(head):]
        return q

    inject = dict(inject_fields or {})
    inj_cols = []
    for name, ipath in inject.items():
        ip = of_element(ipath)
        inj_cols.append(F.try_variant_get(F.col("__item"), _norm_path(ip), "variant").alias(f"__inj_{name}"))
    el = el.select(*keep, "__item_pos", F.col("__item").alias("__doc"), *inj_cols)
    cfg = dict(base)
    cfg["path"] = of_element(cfg.get("path", "$"))
    names = {f"__inj_{n}": n for n in inject}
    out = extract_with(el, cfg, doc_col="__doc", keep=[*keep, "__item_pos", *names])
    still = [c for c in names if c in out.columns and isinstance(out.schema[c].dataType, T.VariantType)]
    if still:  # strategies that do not type what they keep
        found = el.agg(*[F.schema_of_variant_agg(c).alias(c) for c in still]).first()
        out = out.withColumns({c: typed(F.col(c), spark_type_for(found[c])) for c in still})
    rest = [c for c in out.columns if c not in names and c not in inject]
    return out.select(*rest, *(F.col(c).alias(n) for c, n in names.items())).drop("__item_pos")


# EXT-05 ---------------------------------------------------------------------------------
def unpivot_table(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str], var_name: str = "variable",
                  value_name: str = "value") -> DataFrame:
    """Wide -> long; absent value columns are ignored; none present -> unchanged.
    Values are cast to a common type (double if all numeric, else string)."""
    ids = [c for c in id_vars if c in df.columns]
    vals = [c for c in value_vars if c in df.columns]
    if not vals:
        return df
    from quarry.operators.aggregates import numeric_columns

    common = "double" if set(vals) <= set(numeric_columns(df)) else "string"
    cast = df.select(*ids, *[F.col(c).cast(common).alias(c) for c in vals])
    return cast.unpivot(ids, vals, var_name, value_name)


# EXT-06 ---------------------------------------------------------------------------------
def _key_text(v: Column) -> Column:
    """A key as text that is equal for equal values: numbers by value, the rest by their JSON."""
    number = F.concat(F.lit("n"), F.try_variant_get(v, "$", "decimal(38,9)").cast("string"))
    return F.when(F.schema_of_variant(v).isin("STRING", "BOOLEAN"), F.to_json(v)).otherwise(F.coalesce(number, F.to_json(v)))


#: Up to so many keys are compared one by one, more are probed by binary search.
FEW = 16


def doc_join(docs: DataFrame, left: Mapping[str, str], right: Mapping[str, str], how: str = "left",
             doc_col: str = "doc", id_col: str = "file_path") -> DataFrame:
    """Join two object arrays of the same document on a key, inside the document: no shuffle, and keys sorted once
    and probed, so the time goes with the elements and their matches.

    Numbers are equal by value; null keys match nothing.  The key has the left
    name; other names of the right that the left has too get ``_right``.  A
    document without the left or the right array, or with an empty left one, gives
    no rows; one whose right array is empty or never has the key gives its left
    rows, whatever the join."""
    if how not in HOWS:
        raise ValueError(f"how must be one of {', '.join(HOWS)}")
    lk, rk = left["key"], right["key"]

    def elements(path: str) -> Column:
        *steps, last = split_path(strip_wildcard(path))
        v = F.col(doc_col)
        if not steps:
            return F.try_variant_get(at(v, last), "$", "array<variant>")
        arrays = F.array(v)
        for seg in steps:
            arrays = F.flatten(F.transform(arrays, lambda x, seg=seg: F.coalesce(F.try_variant_get(at(x, seg), "$", "array<variant>"), F.array().cast("array<variant>"))))
        return F.flatten(F.transform(arrays, lambda x: F.coalesce(F.try_variant_get(at(x, last), "$", "array<variant>"), F.array().cast("array<variant>"))))

    # both sides' keys and types by one aggregate over the documents
    def fields(found: str | None) -> dict[str, str]:
        if not (found or "").startswith("ARRAY<OBJECT<"):
            return {}
        return {f.name: _kind(f.dataType) for f in T.DataType.fromDDL(_as_ddl(found)).elementType.fields}

    def types_of(values: Mapping[str, Column]) -> dict[str, dict[str, str] | None]:
        """Fields of each side's elements; None where the arrays hold other things than objects."""
        row = docs.agg(*(F.schema_of_variant_agg(v).alias(n) for n, v in values.items())).first()
        return {n: fields(row[n]) if (row[n] or "VOID").startswith(("ARRAY<OBJECT<", "VOID", "ARRAY<VOID>")) else None for n in values}

    sides_of = {"l": left["path"], "r": right["path"]}
    single = {n: at(F.col(doc_col), strip_wildcard(_norm_path(p))) for n, p in sides_of.items() if len(split_path(strip_wildcard(p))) == 1}
    found = types_of(single) if single else {}
    rest = {n: F.to_variant_object(F.filter(elements(p), is_object)) for n, p in sides_of.items() if found.get(n) is None}
    found |= types_of(rest) if rest else {}
    lt, rt = found["l"] or {}, found["r"] or {}

    # keys of one plain type are compared as such, others as text
    plain = lt.get(lk) if lt.get(lk) == rt.get(rk) and lt.get(lk) in ("bigint", "string") else None

    def keyed(values: Column, key: str) -> Column:
        k = (lambda v: F.try_variant_get(child(v, key), "$", plain)) if plain else (lambda v: _key_text(child(v, key)))
        return F.transform(F.filter(values, is_object), lambda v: F.struct(k(v).alias("k"), v.alias("v")))

    def in_order(side: str) -> Column:
        """Keys with their places, sorted: a side that is probed."""
        return F.array_sort(F.filter(F.transform(side, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"))), lambda x: x["k"].isNotNull()))

    sides = docs.select(id_col, keyed(elements(left["path"]), lk).alias("__l"), keyed(elements(right["path"]), rk).alias("__r"))
    sides = sides.withColumns({"__ls": in_order("__l"), "__rs": in_order("__r")})
    none = F.lit(None).cast("variant")

    def border(keys: str, before) -> Column:
        """Binary search: how many of the sorted keys lie ``before``."""
        def halve(s, _):
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            return F.when(s["lo"] >= s["hi"], s).when(before(F.get(keys, mid)["k"]), F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(keys)))), F.struct(F.lit(0).alias("lo"), F.size(keys).alias("hi")), halve, lambda s: s["lo"])

    def matches(keys: str, k: Column) -> Column:
        """Places of the elements with this key, in their order."""
        few = F.transform(F.filter(keys, lambda x: x["k"] == k), lambda x: x["i"])
        probed = bound(border(keys, lambda x: x < k), lambda lo: F.transform(F.slice(keys, lo + 1, border(keys, lambda x: x <= k) - lo), lambda x: x["i"]))
        return F.when(k.isNull(), F.array().cast("array<int>")).when(F.size(keys) <= FEW, few).otherwise(probed)

    def pairs(l):
        found = F.transform(matches("__rs", l["k"]), lambda i: F.struct(l["v"].alias("l"), F.get("__r", i)["v"].alias("r")))
        if how not in ("left", "outer"):
            return found
        alone = F.array(F.struct(l["v"].alias("l"), none.alias("r")))
        return bound(found, lambda m: F.when(F.size(m) > 0, m).otherwise(alone))

    joined = F.flatten(F.transform("__l", pairs))
    if how in ("right", "outer"):
        unmatched = F.filter("__r", lambda r: F.size(matches("__ls", r["k"])) == 0)
        joined = F.concat(joined, F.transform(unmatched, lambda r: F.struct(none.alias("l"), r["v"].alias("r"))))
    only_left = F.transform("__l", lambda l: F.struct(l["v"].alias("l"), none.alias("r")))
    # conditions within the value, and an outer explode: filters here would be pushed down and evaluate the arrays once more each
    of_document = F.when((F.size("__l") > 0) & F.col("__r").isNotNull(), F.when(F.size("__rs") > 0, joined).otherwise(only_left))
    rows = sides.select(id_col, F.explode_outer(of_document).alias("__p")).where("__p IS NOT NULL").select(id_col, F.col("__p.l").alias("__l"), F.col("__p.r").alias("__r"))

    key_kind = lt.get(lk, "string") if lt.get(lk) == rt.get(rk, lt.get(lk)) else "double" if {lt.get(lk), rt.get(rk)} <= {"bigint", "double"} else "string"
    key = F.coalesce(child(F.col("__l"), lk), child(F.col("__r"), rk))
    return rows.select(id_col, typed(key, key_kind).alias(lk), *(typed(child(F.col("__l"), n), t).alias(n) for n, t in lt.items() if n != lk),
                       *(typed(child(F.col("__r"), n), t).alias(f"{n}_right" if n in lt else n) for n, t in rt.items() if n != rk))


# EXT-07 / 08 -------------------------------------------------------------------------------
def validate_config(cfg: Mapping[str, Any]) -> list[str]:
    """EXT-08: configuration errors for one table's ``select`` block."""
    errs = []
    s = cfg.get("strategy")
    if s not in STRATEGIES:
        errs.append(f"unknown strategy {s}")
    if s == "array_of_objects" and not cfg.get("path"):
        errs.append("array_of_objects needs a path")
    if s == "headers_data" and cfg.get("strict"):
        if not (cfg.get("headers_key") or cfg.get("infer_headers") or cfg.get("default_headers")):
            errs.append("headers_data needs headers_key, infer_headers or default_headers")
        if not cfg.get("data_key"):
            errs.append("headers_data needs data_key")
    if s == "repeat_over" or cfg.get("repeat_over"):
        ro = cfg.get("repeat_over") or {}
        if not ro.get("path") or not ro.get("as"):
            errs.append("repeat_over needs path and as")
    if s == "unpivot" and not cfg.get("value_vars"):
        errs.append("unpivot needs value_vars")
    if s == "join":
        for side in ("left", "right"):
            if not (cfg.get(side) or {}).get("path") or not (cfg.get(side) or {}).get("key"):
                errs.append(f"join needs {side}.path and {side}.key")
        if cfg.get("how", "left") not in HOWS:
            errs.append(f"join how must be one of {', '.join(HOWS)}")
    return errs


def extract_with(docs: DataFrame, cfg: Mapping[str, Any], doc_col: str = "doc",
                 keep: Sequence[str] = ("file_path",)) -> DataFrame:
    """Dispatch one table's ``select`` config to its strategy."""
    errs = validate_config(cfg)
    if errs:
        raise ValueError("; ".join(errs))
    if cfg.get("repeat_over") and cfg.get("strategy") != "repeat_over":
        ro = cfg["repeat_over"]
        base = {k: v for k, v in cfg.items() if k != "repeat_over"}
        return repeat_over(docs, ro["path"], ro["as"], base, ro.get("inject_fields"), doc_col, keep)
    s = cfg["strategy"]
    if s == "flat_object":
        return flat_object(docs, cfg.get("path", "$"), cfg.get("flatten_nested", True),
                           cfg.get("flatten_separator", "_"), doc_col, keep, cfg.get("max_columns"))
    if s == "headers_data":
        return headers_data(docs, cfg.get("path", "$"), cfg.get("headers_key"), cfg.get("data_key"),
                            cfg.get("infer_headers", False), cfg.get("default_headers"), doc_col, keep, cfg.get("types"), cfg.get("max_columns"))
    if s == "array_of_objects":
        return array_of_objects(docs, cfg["path"], cfg.get("fields"), doc_col, keep, cfg.get("max_columns"))
    if s == "repeat_over":
        return repeat_over(docs, cfg["path"], cfg["as"], cfg["base"], cfg.get("inject_fields"), doc_col, keep)
    if s == "unpivot":
        src = extract_with(docs, cfg["source"], doc_col, keep) if cfg.get("source") else docs
        return unpivot_table(src, list(keep) + list(cfg.get("id_vars", [])), cfg["value_vars"],
                             cfg.get("var_name", "variable"), cfg.get("value_name", "value"))
    if s == "join":
        return doc_join(docs, cfg["left"], cfg["right"], cfg.get("how", "left"), doc_col)
    raise ValueError(f"unknown strategy {s}")


def extract_tables(docs: DataFrame, tables: Sequence[Mapping[str, Any]], doc_col: str = "doc",
                   keep: Sequence[str] = ("file_path",)) -> tuple[dict[str, DataFrame], list[dict]]:
    """EXT-07: every table of a profile from all documents.  Entries with one id
    are united, a type conflict as text.  A table whose configuration is wrong
    becomes a warning; a limit that the user set, or a failing job, stops the run."""
    from quarry.operators.joins import union_diagonal

    parts: dict[str, list[DataFrame]] = {}
    warnings: list[dict] = []
    for t in tables:
        try:
            parts.setdefault(t["id"], []).append(extract_with(docs, t["select"], doc_col, keep))
        except LimitExceeded:
            raise
        except (ValueError, KeyError) as e:  # a bad configuration must not stop the other tables
            warnings.append({"table_id": t.get("id"), "message": str(e)[:500]})
    return {name: union_diagonal(dfs) for name, dfs in parts.items() if dfs}, warnings


def read_documents(spark, paths: str | Sequence[str], path_col: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """Read whole JSON files as documents: (good documents, bad files).

    ``wholetext=True`` gives one row per file; ``try_parse_json`` turns a
    malformed file into a null document that is routed to ``bad``."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias(path_col),
                                                        F.col("value").alias("__text"))
    parsed = raw.select(path_col, F.try_parse_json("__text").alias("doc"))
    good = parsed.filter(F.col("doc").isNotNull())
    bad = parsed.filter(F.col("doc").isNull()).select(path_col, F.lit("invalid JSON").alias("reason"))
    return good, bad
