import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import search as S
from quarry.operators import stats as ST
from quarry.operators import transforms as X


def test_output_options(spark):
    df = spark.createDataFrame([(1.0, " a "), (float("nan"), "b"), (None, None)], "x double, s string")
    out = X.apply_output_options(df, nan_replacement=0.0, string_strip=True, string_case="upper").collect()
    assert [r["x"] for r in out] == [1.0, 0.0, 0.0] and [r["s"] for r in out] == ["A", "B", None]
    with pytest.raises(ValueError):
        X.apply_output_options(df, max_rows=2)
    with pytest.raises(ValueError):
        X.apply_output_options(df, max_columns=1)


def test_query_expansion_and_threshold(spark):
    df = spark.createDataFrame([("cache", "ADR"), ("limits", "other")], "q string, t string")
    got = [r["e"] for r in df.select(S.expand_query(F.col("q"), F.col("t")).alias("e")).collect()]
    assert got[0].startswith("cache architecture decision") and got[1] == "limits"
    hits = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.1)], "query_id string, doc_id int, score double")
    assert S.threshold(hits, 0.5).count() == 1


def test_rrf_fusion(spark):
    kw = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id int, rank int")
    vs = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "query_id string, doc_id int, rank int")
    got = {r["doc_id"]: (r["rank"], r["score"]) for r in S.hybrid_search(kw, vs, top_k=3).collect()}
    assert got[2][0] == 1 and got[2][1] == pytest.approx(0.5 / 62 + 0.5 / 61)
    assert got[1][1] == pytest.approx(0.5 / 61) and got[1][0] == 2 and got[3][0] == 3


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "apple apple banana"), (2, "banana cherry"), (3, "banana")], "id int, text string")
    res = S.bm25_search(docs, "id", "text", [("q", "apple banana")], top_k=3).orderBy("rank").collect()
    assert res[0]["doc_id"] == 1 and len(res) == 3


def test_roles_and_transforms(spark):
    df = spark.createDataFrame([(f"L{i % 3}", float(i), i) for i in range(20)], "lot string, y double, k int")
    roles = {r["column_name"]: r["role"] for r in ST.detect_roles(df).collect()}
    assert roles == {"lot": "factor", "y": "response", "k": "response"}
    t = ST.transform_response(df, "y", "log", where="k > 0").collect()
    assert len(t) == 19 and t[0]["y"] == pytest.approx(0.0)
    gm = {r["lot"]: r for r in ST.group_means(df, "lot", "y").collect()}
    assert gm["L0"]["ci_low"] < gm["L0"]["mean"] < gm["L0"]["ci_high"]


def test_folder_sync_stream(spark, tmpdir_path):
    import json

    from quarry.streaming.streams import folder_sync, read_snapshot

    src = os.path.join(tmpdir_path, "docs")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write(json.dumps({"doc_id": 1, "text": "one"}) + "\n" + json.dumps({"doc_id": 2, "text": "two"}) + "\n")
    snap, ck = os.path.join(tmpdir_path, "snap"), os.path.join(tmpdir_path, "ck")
    schema = "doc_id long, text string"
    folder_sync(spark, src, snap, ck, schema=schema).awaitTermination(120)
    first = {r["doc_id"]: r["action"] for r in read_snapshot(spark, snap).collect()}
    assert first == {1: "inserted", 2: "inserted"}
    with open(os.path.join(src, "b.json"), "w") as f:
        f.write(json.dumps({"doc_id": 2, "text": "two v2"}) + "\n" + json.dumps({"doc_id": 3, "text": "three"}) + "\n")
    folder_sync(spark, src, snap, ck, schema=schema).awaitTermination(120)
    second = {r["doc_id"]: (r["action"], r["text"]) for r in read_snapshot(spark, snap).collect()}
    assert second == {1: ("inserted", "one"), 2: ("updated", "two v2"), 3: ("inserted", "three")}
    assert read_snapshot(spark, snap).count() == 3


def test_related_documents_fill_what_the_budget_leaves(spark):
    contexts = spark.createDataFrame([("q", "c", "1", 10), ("r", "d", "2", 10)], "query_id string, context string, sources string, token_count long")
    related = spark.createDataFrame([("q", i, f"T{i}", "adr", "x" * 400) for i in (1, 2, 3)], "query_id string, rank long, title string, type string, text string")
    got = {r["query_id"]: r for r in S.add_related(contexts, related, max_tokens=60).collect()}
    assert got["q"]["context"].startswith("c### Related Documents\n- **T1** (adr): " + "x" * 150 + "...\n- **T2**")
    assert "T3" not in got["q"]["context"] and got["r"]["context"] == "d" and got["r"]["token_count"] == 10
