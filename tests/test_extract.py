import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import context as CT
from quarry.operators import extract as E
from quarry.plans.profile import check_profile, load_profile, run_profile

DOC = {
    "metadata": {"lot_id": "LOTABC12345", "wafer_id": "W01", "tool_id": "CDSEM01", "recipe_name": "R1"},
    "summary": {"total_images": 50, "valid_images": 48, "mean_cd": 45.2, "sigma_cd": 1.3, "range_cd": 5.8},
    "statistics": {"columns": ["parameter", "mean", "std_dev", "min", "max", "count"],
                   "values": [["cd", 45.2, 1.3, 42.0, 47.8, 48], ["lwr", 3.1, 0.2, 2.7, 3.6, 48],
                              ["swa", 88.0, 0.5], ["height", 60.1, 2.0, 57.0, 63.0, 48, "extra"]]},
    "sites": [
        {"site_id": "S1", "name": "center", "cd_data": {"headers": ["x_position", "y_position", "cd_value", "cd_3sigma"],
                                                        "rows": [[0, 0, 45.1, 1.2], [1, 0, 45.3, 1.1],
                                                                 [0, 1, 44.9, 1.3], [1, 1, 45.0, 1.2]]}},
        {"site_id": "S2", "name": "edge", "cd_data": {"headers": ["x_position", "y_position", "cd_value", "cd_3sigma"],
                                                      "rows": [[10, 0, 44.1, 1.5], [11, 0, 44.3, 1.4],
                                                               [10, 1, 43.9, 1.6], [11, 1, 44.0, 1.5]]}},
        {"site_id": "S3", "name": "notch", "cd_data": {"headers": ["x_position", "y_position", "cd_value", "cd_3sigma"],
                                                       "rows": [[5, 5, 46.0, 1.0], {"x_position": 6, "cd_value": 46.2}]}},
    ],
    "images": [
        {"image_id": "IMG1", "metadata": {"image_name": "a.tif", "acquisition_time": "2024-01-01T10:00:00"},
         "measurements": [{"feature": "f1", "cd": 45.0}, {"feature": "f2", "cd": 46.0, "note": "x"}]},
        {"metadata": {"image_name": "b.tif", "acquisition_time": "2024-01-01T10:05:00"},
         "measurements": [{"feature": "f1", "cd": 44.0}]},
    ],
}


@pytest.fixture()
def docs(spark):
    name = "/data/LOTABC12345_W01_CDSEM01_measurement.json"
    return spark.createDataFrame([(name, json.dumps(DOC))], "file_path string, t string") \
        .select("file_path", F.try_parse_json("t").alias("doc"))


def test_flat_object(docs):
    rows = E.flat_object(docs, "$.summary").collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert r["total_images"] == 50 and r["mean_cd"] == pytest.approx(45.2)
    nested = E.flat_object(docs, "$.metadata").first()
    assert nested["lot_id"] == "LOTABC12345"
    flat = E.flat_object(docs, "$", flatten_nested=True).columns
    assert "summary_mean_cd" in flat and "metadata_lot_id" in flat and "sites" in flat  # list -> JSON text


def test_headers_data_pad_and_cut(docs):
    t = E.headers_data(docs, "$.statistics", "columns", "values").orderBy("parameter").collect()
    assert len(t) == 4
    by = {r["parameter"]: r for r in t}
    assert by["swa"]["min"] is None and by["swa"]["count"] is None  # short row padded
    assert "extra" not in [c for c in t[0].asDict()]  # long row cut
    assert by["cd"]["count"] == 48


def test_headers_inferred_and_default(spark):
    d = spark.createDataFrame([("f", json.dumps({"data": [[1, "a"], [2, "b", True]]}))], "file_path string, t string") \
        .select("file_path", F.try_parse_json("t").alias("doc"))
    inferred = E.headers_data(d, "$", infer_headers=True)
    assert [c for c in inferred.columns if c.startswith("col_")] == ["col_0", "col_1", "col_2"]
    dflt = E.headers_data(d, "$", default_headers=["id", "name"])
    assert set(dflt.columns) >= {"id", "name"} and dflt.count() == 2


def test_repeat_over_sites(docs):
    t = E.extract_with(docs, {"strategy": "headers_data", "path": "{site}.cd_data",
                              "repeat_over": {"path": "$.sites", "as": "site",
                                              "inject_fields": {"site_id": "{site}.site_id"}}})
    rows = t.collect()
    assert len(rows) == 10
    assert sorted({r["site_id"] for r in rows}) == ["S1", "S2", "S3"]
    dict_row = [r for r in rows if r["site_id"] == "S3" and r["x_position"] == 6][0]
    assert dict_row["cd_value"] == pytest.approx(46.2) and dict_row["y_position"] is None


def test_array_of_objects_and_join(docs, spark):
    imgs = E.array_of_objects(docs, "$.images[0].measurements[*]")
    assert imgs.count() == 2 and "note" in imgs.columns
    all_meas = E.extract_with(docs, {"strategy": "array_of_objects", "path": "$.images[*].measurements[*]"})
    assert all_meas.count() == 3
    d = spark.createDataFrame([("f", json.dumps({"a": [{"k": 1, "x": "p"}, {"k": 2, "x": "q"}],
                                                 "b": [{"key": 1, "y": 10}]}))], "file_path string, t string") \
        .select("file_path", F.try_parse_json("t").alias("doc"))
    j = E.doc_join(d, {"path": "$.a[*]", "key": "k"}, {"path": "$.b[*]", "key": "key"}, "left").orderBy("k").collect()
    assert [(r["k"], r["y"]) for r in j] == [(1, 10), (2, None)]


def _parsed(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file_path string, t string").select("file_path", F.try_parse_json("t").alias("doc"))


def test_headers_of_many_kinds_in_one_pass(spark):
    d = _parsed(spark, '{"columns": ["a", "b"], "values": [[1, "x"], {"b": "y", "z": 1}]}', '{"columns": ["a"], "values": [7, "t"]}',
                '{"columns": ["it\'s", "c", "c"], "values": [[1, 2, 3]]}', '{"columns": ["e"], "values": []}')
    t = E.headers_data(d, "$")
    assert t.columns == ["file_path", "a", "e", "it's", "b", "c"]
    got = sorted(((r["a"], r["b"], r["it's"], r["c"]) for r in t.collect()), key=repr)
    assert got == sorted([("1", "x", None, None), (None, "y", None, None), ("7", None, None, None), ("t", None, None, None), (None, None, 1, 3)], key=repr)
    many = _parsed(spark, *['{"columns": ["c%d"], "values": [[%d]]}' % (i, i) for i in range(20)])
    plan = E.headers_data(many, "$")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0
    with pytest.raises(E.LimitExceeded):
        E.headers_data(many, "$", max_columns=19)


def test_more_than_a_thousand_keys_and_quoted_ones(spark):
    wide = _parsed(spark, json.dumps({f"k{i}": i for i in range(1001)} | {"it's": 1, 'q"x': 2, "both'\"": 3}))
    tables, warnings = E.extract_tables(wide, [{"id": "t", "select": {"strategy": "flat_object"}}])
    assert not warnings and len(tables["t"].columns) == 1005
    r = tables["t"].first()
    assert (r["it's"], r['q"x'], r["both'\""], r["k1000"]) == (1, 2, 3, 1000)
    with pytest.raises(E.LimitExceeded):
        E.extract_tables(wide, [{"id": "t", "select": {"strategy": "flat_object", "max_columns": 1000}}])


def test_doc_join_edges(spark):
    d = _parsed(spark, '{"l": [{"k": 1, "x": "p"}, {"k": null, "x": "n"}], "r": []}', '{"l": [{"k": 1, "x": "q"}], "r": [{"k": 1.0, "x": "R"}, {"k": 3, "x": "S"}]}',
                '{"l": [{"k": 1, "x": "lost"}]}')
    join = lambda how: sorted(((r["file_path"], r["x"], r["x_right"]) for r in E.doc_join(d, {"path": "$.l[*]", "key": "k"}, {"path": "$.r", "key": "k"}, how).collect()), key=repr)
    empty = [("0", "n", None), ("0", "p", None)]  # an empty right side gives the left rows
    assert join("inner") == [*empty, ("1", "q", "R")] == join("left")
    assert join("outer") == sorted([*empty, ("1", "q", "R"), ("1", None, "S")], key=repr) == join("right")
    same, _ = E.extract_tables(d, [{"id": "t", "select": {"strategy": "array_of_objects", "path": "$.l"}},
                                   {"id": "t", "select": {"strategy": "array_of_objects", "path": "$.r", "fields": ["x", "k"]}}])
    assert same["t"].count() == 6
    assert "Exchange" not in E.doc_join(d, {"path": "$.l", "key": "k"}, {"path": "$.r", "key": "k"})._jdf.queryExecution().executedPlan().toString()


def test_unpivot_and_config_errors(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    assert E.unpivot_table(df, ["id"], ["a", "b", "zz"]).count() == 2
    assert E.unpivot_table(df, ["id"], ["zz"]).columns == df.columns
    assert E.validate_config({"strategy": "nope"})
    assert E.validate_config({"strategy": "join", "left": {"path": "$.a"}})
    assert E.strip_wildcard("$.items[*]") == "$.items"


def test_context_priority_and_images(docs):
    fields = {"lot_id": {"regex": {"pattern": r"^(?P<lot_id>LOT[A-Z0-9]+)_", "group": "lot_id"}},
              "wafer_id": {"json_path": "$.metadata.wafer_id"},
              "tool_id": {"json_path": "$.metadata.nothing", "default": "T?"},
              "recipe": {"default": "dflt"}}
    ctx = CT.file_context(docs, fields, overrides={"recipe": "OVR", "tool_id": "X"}, allowed_overrides=["recipe"]).first()
    assert ctx["lot_id"] == "LOTABC12345" and ctx["wafer_id"] == "W01"
    assert ctx["tool_id"] == "T?" and ctx["recipe"] == "OVR"
    img = CT.image_context(docs, {"acquired": "$.acquisition_time"}).orderBy("image_id").collect()
    assert [r["image_id"] for r in img] == ["IMG1", "b.tif"]
    assert img[1]["acquired"] == "2024-01-01T10:05:00"


def test_required_policy(docs):
    ctx = CT.file_context(docs, {"lot": {"json_path": "$.missing"}})
    kept, warn = CT.required_pattern_policy(ctx, ["lot"], "skip_file")
    assert kept.count() == 0 and warn.count() == 1
    with pytest.raises(ValueError):
        CT.required_pattern_policy(ctx, ["lot"], "error")


PROFILE = """
id: cdsem
title: CD-SEM profile
contexts:
  lot_id: {regex: {pattern: '^(?P<lot_id>LOT[A-Z0-9]+)_', group: lot_id}}
  wafer_id: {json_path: $.metadata.wafer_id}
tables:
  - id: summary
    select: {strategy: flat_object, path: $.summary}
  - id: sites
    select:
      strategy: headers_data
      path: '{site}.cd_data'
      repeat_over: {path: $.sites, as: site, inject_fields: {site_id: '{site}.site_id'}}
validation:
  sites:
    constraints: {cd_value: {min: 40, max: 50}}
outputs:
  aggregations:
    - {id: site_means, table: sites, group_by: [site_id], aggregations: {cd_value: mean}}
"""


def test_run_profile_end_to_end(spark, tmpdir_path):
    for i, lot in enumerate(["LOTAAA1", "LOTBBB2"]):
        d = json.loads(json.dumps(DOC))
        d["metadata"]["wafer_id"] = f"W0{i}"
        with open(os.path.join(tmpdir_path, f"{lot}_W0{i}_measurement.json"), "w") as f:
            json.dump(d, f)
    with open(os.path.join(tmpdir_path, "broken.json"), "w") as f:
        f.write("{not json")
    prof = load_profile(PROFILE)
    res = run_profile(spark, prof, tmpdir_path, output_dir=os.path.join(tmpdir_path, "out"))
    assert res["tables"]["summary"].count() == 2
    sites = res["tables"]["sites"]
    assert sites.count() == 20 and {"lot_id", "wafer_id", "site_id"} <= set(sites.columns)
    assert res["tables"]["site_means"].count() == 3
    assert res["bad_files"].count() == 1
    assert res["validation"].filter("table_name = 'sites'").first()["valid"] is True
    assert os.path.isdir(os.path.join(tmpdir_path, "out", "_combined"))
    assert check_profile({"tables": [{"id": "a", "select": {"strategy": "bad"}}]})


def test_keys_that_differ_in_case_are_columns_of_their_own(spark):
    d = spark.createDataFrame([("f", '{"id": 1, "ID": 2, "id_2": 3, "n": {"a": 4, "A": 5}, "l": [{"k": 1, "K": "x"}], "h": ["v", "V"], "rows": [[7, 8]]}')], "file_path string, t string") \
        .select("file_path", F.try_parse_json("t").alias("doc"))
    flat = E.flat_object(d)
    assert len({c.lower() for c in flat.columns}) == len(flat.columns)
    r = flat.first()
    assert sorted(r[c] for c in flat.columns if c.lower().startswith("id")) == [1, 2, 3] and {r[c] for c in flat.columns if c.lower().startswith("n_a")} == {4, 5}
    flat.select("id").collect()
    rows = E.array_of_objects(d, "$.l[*]")
    assert [c.lower() for c in rows.columns] == ["file_path", "k", "k_2"] and set(rows.first()[1:]) == {1, "x"}
    block = E.headers_data(d, "$", headers_key="h", data_key="rows")
    assert tuple(block.select("v", "V_2").first()) == (7, 8)
    assert E.distinct_names(["a", "A", "a_2", "B"], ["b"]) == ["a", "A_3", "a_2", "B_2"]


def test_block_headers_are_read_once(spark):
    """the condition on headers is no filter of its own, which would read them again."""
    docs = spark.createDataFrame([('{"columns": ["a"], "values": [[1], [2]]}',), ('{"values": [[3]]}',), ('{"columns": ["a"]}',)], "t string").select(F.try_parse_json("t").alias("doc"))
    out = E.headers_data(docs, "$", keep=[], types={"a": "bigint"})
    assert out._jdf.queryExecution().optimizedPlan().toString().count('$["columns"]') == 1
    assert sorted(r["a"] for r in out.collect()) == [1, 2]
