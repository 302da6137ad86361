import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import context as CT
from quarry.plans.profile import governance_check, load_profile, run_profile
from quarry.sources.readers import discover_files


def test_governance_limits(spark, tmpdir_path):
    for i in range(3):
        with open(os.path.join(tmpdir_path, f"f{i}.json"), "w") as f:
            f.write(json.dumps({"a": i}))
    files = discover_files(spark, tmpdir_path)
    assert governance_check(files, {"max_files": 10}) == []
    assert governance_check(files, {"max_files": 2})
    prof = load_profile({"id": "p", "tables": [{"id": "t", "select": {"strategy": "flat_object"}}],
                         "limits": {"max_files": 2}})
    with pytest.raises(ValueError):
        run_profile(spark, prof, tmpdir_path)


def test_file_filter_in_profile(spark, tmpdir_path):
    for name in ("LOT1_keep.json", "LOT2_skip.json"):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(json.dumps({"summary": {"v": 1}}))
    prof = {"id": "p", "tables": [{"id": "s", "select": {"strategy": "flat_object", "path": "$.summary"}}],
            "file_filter": {"field": "filename", "operator": "contains", "value": "keep"}}
    res = run_profile(spark, prof, tmpdir_path)
    rows = res["tables"]["s"].collect()
    assert len(rows) == 1 and rows[0]["file_path"].endswith("LOT1_keep.json")


def test_regex_transforms(spark):
    df = spark.createDataFrame([("/x/LOT9_20240131_run.json",), ("/x/other.json",)], "p string")
    out = df.select(
        CT.regex_capture(F.col("p"), r"_(?P<d>\d{8})_", "d", "parse_date").alias("d"),
        CT.regex_capture(F.col("p"), r"/(?P<lot_id>lot\d)_", "lot_id", "upper").alias("lot"),
        CT.regex_capture(CT.file_name(F.col("p")), r"^(\w+)\.json$", 1).alias("stem")).collect()
    assert out[0]["d"] == "2024-01-31" and out[1]["d"] is None
    assert out[0]["lot"] is None  # case-sensitive pattern: no match
    assert out[1]["stem"] == "other"
    assert CT.python_pattern_to_java(r"(?P<a>x)(?P=a)") == r"(x)\1"


CONTRACT = {
    "schema_version": "1.0.0", "version": 1, "meta": {"profile_id": "cd", "title": "CD"},
    "context_defaults": {"defaults": {"job": "none"}, "regex_patterns": [{"field": "lot", "pattern": "(?P<lot>LOT[0-9]+)", "required": True}]},
    "contexts": [{"name": "run", "level": "run", "paths": ["$.meta"], "key_map": {"wafer": "$.meta.wafer"}},
                 {"name": "image", "level": "image", "paths": ["$.images[*].metadata"], "key_map": {"taken": "$.time"}}],
    "levels": [{"name": "run", "tables": [
        {"id": "sites", "label": "Sites", "select": {"strategy": "headers_data", "path": "$.sites[{i}].cd", "headers_key": "h", "data_key": "rows",
                                                     "repeat_over": {"path": "$.sites", "as": "i", "inject_fields": {"site": "$.sites[{i}].id"}}},
         "validation_constraints": [{"column": "y", "type": "range", "max": 5}], "stable_columns": ["x", "gone"]}]},
        {"name": "image", "tables": [{"id": "pictures", "label": "P", "select": {"strategy": "array_of_objects", "path": "$.images[*]"}}]}],
    "outputs": {"defaults": [{"id": "all", "from_level": "run", "from_tables": ["sites", "pictures"], "include_context": False}]},
}


def _contract_docs(folder):
    doc = {"meta": {"wafer": "W1"}, "images": [{"image_id": "i1", "metadata": {"time": "t1"}}],
           "sites": [{"id": "s1", "cd": {"h": ["x", "y"], "rows": [[1, 2], [3, 9]]}}, {"id": "s2", "cd": {"h": ["y"], "rows": [[4]]}}]}
    with open(os.path.join(folder, "LOT7_a.json"), "w") as f:
        json.dump(doc, f)


def test_contract_layout(spark, tmpdir_path):
    _contract_docs(tmpdir_path)
    res = run_profile(spark, CONTRACT, tmpdir_path)
    rows = sorted((r["site"], r["x"], r["y"], r["lot"], r["wafer"], r["job"]) for r in res["tables"]["sites"].fillna(0).collect())
    assert rows == [("s1", 1, 2, "LOT7", "W1", "none"), ("s1", 3, 9, "LOT7", "W1", "none"), ("s2", 0, 4, "LOT7", "W1", "none")]
    assert res["tables"]["pictures"].first()["taken"] == "t1"
    assert res["tables"]["all"].count() == 4
    assert [w["message"] for w in res["warnings"]] == ["missing_columns: gone"]
    assert {r["table_name"]: r["valid"] for r in res["validation"].collect()}["sites"] is False


def test_validation_policies(spark, tmpdir_path):
    _contract_docs(tmpdir_path)
    with pytest.raises(ValueError, match="sites has 1 errors"):
        run_profile(spark, {**CONTRACT, "on_validation_fail": "stop"}, tmpdir_path)
    out = run_profile(spark, {**CONTRACT, "on_validation_fail": "quarantine"}, tmpdir_path)["tables"]
    assert [(r["y"], r["failed_rules"], r["__table_id__"]) for r in out["validation_failures"].collect()] == [(9, ["y:max"], "sites")]
    assert out["sites"].count() == 2


def test_profiles_with_mistakes_raise():
    for wrong in ({"surprise": 1}, {"population": {"stategy": "all"}}, {"on_validation_fail": "maybe"},
                  {"outputs": {"defaults": [{"id": "o", "from_tables": ["nowhere"]}]}}):
        with pytest.raises(ValueError):
            load_profile({**CONTRACT, **wrong})


def test_run_and_image_context_have_toggles_of_their_own(spark, tmpdir_path):
    _contract_docs(tmpdir_path)

    def columns(own=None, **kw):
        prof = {**CONTRACT, "outputs": {"defaults": [{"id": "all", "from_level": "run", "from_tables": ["sites", "pictures"], **(own or {})}]}}
        got = set(run_profile(spark, prof, tmpdir_path, **kw)["tables"]["all"].columns)
        return {"lot", "wafer"} <= got, "taken" in got

    assert columns() == (True, True)
    assert columns({"include_context": False}) == (False, False)
    assert columns({"include_run_context": True, "include_image_context": False}) == (True, False)
    assert columns({"include_context": False}, include_image_context=True) == (False, True)
    assert columns({"include_image_context": True}, include_run_context=False) == (False, True)
    assert columns(include_context=False) == (False, False)


def test_tables_of_one_id_in_two_levels_keep_all_rules(spark, tmpdir_path):
    _contract_docs(tmpdir_path)
    block = {"strategy": "headers_data", "path": "$.sites[{i}].cd", "headers_key": "h", "data_key": "rows", "repeat_over": {"path": "$.sites", "as": "i"}}
    levels = [{"name": "run", "tables": [{"id": "t", "select": block, "validation_constraints": [{"column": "y", "type": "range", "max": 5}]}]},
              {"name": "image", "tables": [{"id": "t", "select": {"strategy": "array_of_objects", "path": "$.images[*]"}, "validation_constraints": [{"column": "x", "type": "range", "max": 2}]}]}]
    res = run_profile(spark, {**CONTRACT, "levels": levels, "outputs": {}, "on_validation_fail": "quarantine"}, tmpdir_path)
    assert sorted((r["y"], tuple(r["failed_rules"])) for r in res["tables"]["validation_failures"].collect()) == [(9, ("x:max", "y:max"))] or \
        sorted((r["y"], tuple(sorted(r["failed_rules"]))) for r in res["tables"]["validation_failures"].collect()) == [(9, ("x:max", "y:max"))]
    assert res["tables"]["t"].count() == 3


def test_numeric_errors_and_time_fields(spark, tmpdir_path):
    for k, v in enumerate(["1", "2", "3", "x"]):
        with open(os.path.join(tmpdir_path, f"f{k}.json"), "w") as f:
            json.dump({"meta": {"at": f"2024-01-0{k + 1} 10:00"}, "s": {"v": v, "w": str(k)}}, f)
    prof = {"schema_version": "1.0.0", "version": 1, "meta": {"profile_id": "n"},
            "contexts": [{"name": "run", "level": "run", "paths": ["$.meta"], "key_map": {"at": "$.meta.at"}, "time_fields": {"at": "%Y-%m-%d %H:%M"}}],
            "levels": [{"name": "run", "tables": [{"id": "s", "select": {"strategy": "flat_object", "path": "$.s"}}]}]}
    run = lambda errors: run_profile(spark, {**prof, "normalization": {"numeric_coercion": True, "numeric_errors": errors}}, tmpdir_path)["tables"]["s"]
    assert sorted(r["v"] for r in run("ignore").collect()) == ["1", "2", "3", "x"] and dict(run("ignore").dtypes)["w"] == "double"
    assert dict(run("coerce").dtypes)["v"] == "double" and sorted(str(r["at"]) for r in run("coerce").collect())[0] == "2024-01-01 10:00:00"
    with pytest.raises(ValueError, match="numeric columns: v"):
        run("raise")


def test_profile_documents_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """a nation's orders are cut in documents; rows stay the same."""
    from quarry.plans import q_quality

    monkeypatch.setattr(q_quality, "_DOC_ORDERS", 10)
    sf = str(tmp_path)
    spark.range(2).selectExpr("id AS n_nationkey").write.parquet(f"{sf}/nation.parquet")
    spark.range(6).selectExpr("id AS c_custkey", "id % 2 AS c_nationkey").write.parquet(f"{sf}/customer.parquet")
    spark.range(100).selectExpr("id AS o_orderkey", "id % 6 AS o_custkey", "3000.0D + id AS o_totalprice", "'O' AS o_orderstatus", "'1-URGENT' AS o_orderpriority").write.parquet(f"{sf}/orders.parquet")
    rows = q_quality._run_profile(spark, sf)["orders"].select("file_path", "o_orderkey", "nation").collect()
    assert {(r["o_orderkey"], r["nation"]) for r in rows} == {(str(i), i % 6 % 2) for i in range(100)} and len(rows) == 100
    assert len({r["file_path"] for r in rows}) == 10
