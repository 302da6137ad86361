import json
import os

import pytest

from quarry.sources import readers as R
from quarry.sources import sinks as K
from quarry.sources.probe import precheck_files, probe_schema, select_tables, table_availability

CSV = """id,name,value,category,created_at
1,alpha,10.5,A,2024-01-01
2,beta,,B,2024-01-02
3,gamma,30.1,A,2024-01-03
4,delta,NULL,C,2024-01-04
5,eps,50.0,B,2024-01-05
"""


def _write(d, name, text, mode="w"):
    p = os.path.join(d, name)
    with open(p, mode) as f:
        f.write(text)
    return p


def test_csv_markers_and_types(spark, tmpdir_path):
    p = _write(tmpdir_path, "sample.csv", CSV)
    df = R.read_delimited(spark, p)
    types = dict(df.dtypes)
    assert types["id"] == "bigint" and types["value"] == "double" and types["created_at"] == "date"
    vals = {r["id"]: r["value"] for r in df.collect()}
    assert vals[2] is None and vals[4] is None and vals[1] == 10.5


def test_delimiter_detection(spark, tmpdir_path):
    tsv = _write(tmpdir_path, "s.tsv", "id\tname\tvalue\n1\ta\t1.0\n2\tb\t2.0\n3\tc\t3.0\n")
    semi = _write(tmpdir_path, "s2.csv", "id;name\n1;a\n")
    det = {os.path.basename(r["file_path"]): r["delimiter"] for r in R.detect_delimiters(spark, [tsv, semi]).collect()}
    assert det == {"s.tsv": "\t", "s2.csv": ";"}
    assert R.read_delimited(spark, tsv).count() == 3


def test_encoding_detection(spark, tmpdir_path):
    _write(tmpdir_path, "bom.csv", b"\xef\xbb\xbfa,b\n1,2\n", "wb")
    _write(tmpdir_path, "latin.csv", "caf\xe9,1\n".encode("latin-1"), "wb")
    _write(tmpdir_path, "plain.csv", "x,y\n", "w")
    enc = {os.path.basename(r["file_path"]): r["encoding"] for r in R.detect_encodings(spark, tmpdir_path).collect()}
    assert enc == {"bom.csv": "utf-8-sig", "latin.csv": "latin-1", "plain.csv": "utf-8"}


def test_json_kinds_and_precheck(spark, tmpdir_path):
    recs = [{"id": 1, "name": "a", "value": 1.5, "active": True}, {"id": 2, "name": "b", "value": None, "active": False}]
    arr = _write(tmpdir_path, "a.json", json.dumps(recs))
    jl = _write(tmpdir_path, "b.jsonl", "\n".join(json.dumps(r) for r in recs))
    bad = _write(tmpdir_path, "c.json", "{broken")
    empty = _write(tmpdir_path, "d.json", "")
    kinds = {os.path.basename(r["file_path"]): r["kind"] for r in R.detect_json_kind(spark, [arr, jl]).collect()}
    assert kinds == {"a.json": "json", "b.jsonl": "jsonl"}
    assert R.read_json(spark, [arr, jl]).count() == 4
    issues = {(os.path.basename(r["file_path"]), r["code"]) for r in precheck_files(spark, [arr, bad, empty]).collect()}
    assert issues == {("c.json", "INVALID_JSON"), ("d.json", "EMPTY_FILE")}


def test_read_options_and_probe(spark):
    df = spark.createDataFrame([(i, i * 10, f"n{i}") for i in range(100)], "id long, value long, name string")
    out = R.apply_read_options(df, columns=["id", "value", "zz"], exclude_columns=["value"], skip_rows=2,
                               row_limit=3, order_by=["id"])
    assert [r["id"] for r in out.collect()] == [2, 3, 4]
    with pytest.raises(ValueError):
        R.apply_read_options(df, row_limit=3)
    pr = {r["column_name"]: r for r in probe_schema(df, samples=3, order_by=["id"]).collect()}
    assert pr["id"]["inferred_type"] == "integer" and pr["id"]["distinct_count"] == 100
    assert pr["name"]["samples"] == "n0|n1|n2"


def test_discovery_predicates_and_registry(spark, tmpdir_path):
    os.makedirs(os.path.join(tmpdir_path, "sub"))
    _write(tmpdir_path, "LOT1_a.json", "{}")
    _write(tmpdir_path, "sub/LOT2_b.json", '{"x": 1}')
    _write(tmpdir_path, "notes.md", "hi")
    files = R.discover_files(spark, tmpdir_path)
    assert files.count() == 3 and files.filter("supported").count() == 2
    tree = {"and": [{"field": "extension", "operator": "equals", "value": ".JSON"},
                    {"not": [{"field": "filename", "operator": "startswith", "value": "lot2"}]}]}
    assert [r["filename"] for r in files.filter(R.file_predicate(tree)).collect()] == ["LOT1_a.json"]
    assert R.reader_for("x.parquet") is not None
    with pytest.raises(ValueError):
        R.reader_for("x.doc")
    with pytest.raises(ValueError):
        R.reader_for("x.xlsx")
    assert R.reader_for("x.bin", media_type="text/csv; charset=utf-8") is R.READERS[".csv"]


def test_csv_files_with_other_headers(spark, tmpdir_path):
    _write(tmpdir_path, "a.csv", "a,b\n1,2\n")
    _write(tmpdir_path, "b.csv", "b,a\n3,4\n")
    _write(tmpdir_path, "c.csv", "b;c\n5;x\n")
    df = R.read_delimited(spark, tmpdir_path)
    assert sorted(((r["a"], r["b"], r["c"]) for r in df.collect()), key=repr) == [(1, 2, None), (4, 3, None), (None, 5, "x")]


def test_probe_samples_are_the_first_values_there(spark):
    df = spark.createDataFrame([(i, None if i < 100 else i) for i in range(200)], "id int, late int")
    got = {r["column_name"]: r["samples"] for r in probe_schema(df, samples=3, order_by=["id"]).collect()}
    assert got == {"id": "0|1|2", "late": "100|101|102"}


def test_unreadable_tables_are_failed(spark):
    read = spark.createDataFrame([("f", "t", "a"), ("f", "t", "b"), ("f", "u", None), ("g", None, None)], "file_path string, table_id string, column_name string")
    got = {(r["file_path"], r["table_id"]): r["status"] for r in table_availability(read, {"t": ["a", "b"], "u": ["x"]}).collect()}
    assert got == {("f", "t"): "AVAILABLE", ("f", "u"): "FAILED", ("g", "<unknown>"): "FAILED"}


def test_table_availability(spark):
    long = spark.createDataFrame([("f1", "t1", "a"), ("f1", "t1", "b"), ("f2", "t1", "a"), ("f1", "t2", "z")],
                                 "file_path string, table_id string, column_name string")
    av = {(r["file_path"], r["table_id"]): r["status"] for r in
          table_availability(long, {"t1": ["a", "b"], "t2": ["z"]}).collect()}
    assert av == {("f1", "t1"): "AVAILABLE", ("f2", "t1"): "PARTIAL", ("f1", "t2"): "AVAILABLE"}
    sel = {r["file_path"]: r["tables"] for r in select_tables(table_availability(long, {"t1": ["a", "b"]})).collect()}
    assert sel["f1"] == ["t1", "t2"]


def test_sinks(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.5)], "id int, s string, v double")
    m = K.write_dataset(df, tmpdir_path, "ds1", lineage=["parent0"])
    assert m["row_count"] == 2 and [c["nullable"] for c in m["columns"]] == [False, False, True]
    data, man = R.read_dataset(spark, tmpdir_path, "ds1")
    assert data.count() == 2
    assert K.sanitize_name('a<b>:c"d/e\\f|g?h*__') == "a_b_c_d_e_f_g_h"
    assert len(K.stable_id({"b": 1, "a": 2})) == 8 and K.stable_id({"a": 2, "b": 1}) == K.stable_id({"b": 1, "a": 2})
    rid = df.select(K.row_id(["id", "s"]).alias("r")).collect()
    assert len({r["r"] for r in rid}) == 2
    K.write_tables({"t/1": df, "t2": df.select("id")}, os.path.join(tmpdir_path, "out"))
    assert spark.read.parquet(os.path.join(tmpdir_path, "out", "_combined")).count() == 4


def test_headers_that_differ_after_64_ki_characters(spark, tmpdir_path):
    long = "h" * 70_000
    for name, text in (("a.csv", f"{long},b,c\n0,1,2\n"), ("b.csv", f"{long},c,b\n0,2,1\n")):
        _write(tmpdir_path, name, text)
    assert [(r["b"], r["c"]) for r in R.read_delimited(spark, tmpdir_path).collect()] == [(1, 2), (1, 2)]
    semi = _write(tmpdir_path, "late.txt", f"{long};b;c\n")
    assert R.detect_delimiters(spark, semi).first()["delimiter"] == ";"


def test_types_are_ruled_out_by_the_first_rows(spark, monkeypatch):
    """few types are tried on all rows; what the first rows leave open the others still decide."""
    monkeypatch.setattr(R, "HEAD_ROWS", 2)
    rows = [("1", "1", "1", "t", "2024-01-01", None, "x"), ("2", "2", "2", "f", "2024-01-02", None, "y"), (" 3", "3.5", "z", "true", "2024-01-03 10:00:00", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string").coalesce(1)
    out = R.infer_types(df)
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "date", "f": "string", "g": "string"}
    assert [r["a"] for r in out.collect()] == [1, 2, 3]
    assert dict(R.infer_types(df.limit(0)).dtypes) == dict(df.dtypes)
