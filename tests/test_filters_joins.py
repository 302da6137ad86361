import hashlib

import pytest

from quarry.operators import aggregates as A
from quarry.operators import filters as FL
from quarry.operators import joins as J
from quarry.operators import sorting as SO
from quarry.operators import transforms as X


def _md5_rank(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{k}{seed}".encode()).hexdigest(), k))


def test_population_policies(spark):
    small = spark.createDataFrame([(i, i * 10) for i in range(1, 6)], "id long, value long")
    assert [r["id"] for r in FL.population(small, "first_n", {"n": 3, "order_by": ["id"]}).collect()] == [1, 2, 3]
    big = spark.createDataFrame([(i, i) for i in range(100)], "id long, value long")
    s1 = sorted(r["id"] for r in FL.sample_n(big, 10, ["id"], 42).collect())
    s2 = sorted(r["id"] for r in FL.sample_n(big.repartition(7), 10, ["id"], 42).collect())
    assert s1 == s2 == sorted(_md5_rank(range(100))[:10])
    assert FL.sample_n(small, 10, ["id"]).count() == 5  # fewer rows than n -> all
    st = spark.createDataFrame([("valid", 1), ("invalid", 2), ("valid", 3), ("rejected", 4)], "status string, value long")
    eq = FL.apply_row_filters(st, [{"column": "status", "operator": "equals", "value": "valid"}])
    assert [r["value"] for r in eq.orderBy("value").collect()] == [1, 3]
    ne = FL.apply_row_filters(st, [{"column": "status", "operator": "not_equals", "value": "rejected"}])
    assert ne.count() == 3
    bt = spark.createDataFrame([(v,) for v in (5, 15, 25, 35, 45)], "value long")
    got = FL.apply_row_filters(bt, [{"column": "value", "operator": "between", "value": [10, 40]}])
    assert [r["value"] for r in got.orderBy("value").collect()] == [15, 25, 35]


def test_stratified_matches_window_bruteforce(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, s string")
    got = sorted(r["id"] for r in FL.sample_stratified(df, "s", 300, ["id"], 7).collect())
    counts = {}
    for i, s in rows:
        counts.setdefault(s, []).append(i)
    want = []
    for s, ids in counts.items():
        q = max(1, int(len(ids) * 300 / len(rows)))
        want += _md5_rank(ids, 7)[:q]
    assert got == sorted(want)


def test_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]], "x double")
    assert FL.outliers_iqr(df, ["x"]).count() == 9
    assert FL.outliers_zscore(df, ["x"], 2.0).count() == 9
    const = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert FL.outliers_zscore(const, ["x"]).count() == 2  # std 0 -> unchanged


def test_transforms(spark):
    df = spark.createDataFrame([(1.0, "a", "nm"), (2.0, "b", "um"), (3.0, "c", "mm")], "cd_um double, old_name string, u string")
    out = X.column_transforms(df, [{"source": "cd_um", "target": "cd_nm", "transform": "unit_convert",
                                    "args": {"from_unit": "um", "to_unit": "nm"}},
                                   {"source": "old_name", "target": "new_name", "transform": "rename"}])
    assert [r["cd_nm"] for r in out.collect()] == [1000.0, 2000.0, 3000.0]
    assert "old_name" not in out.columns and "new_name" in out.columns
    per_row = X.unit_convert(df, "cd_um", unit_column="u", target="nm").collect()
    assert [r["nm"] for r in per_row] == [1.0, 2000.0, 3000000.0]
    assert X.strptime_to_java("%Y-%m-%d %H:%M:%S") == "yyyy-MM-dd HH:mm:ss"
    div = X.calculated_column(df, "r", "cd_um", "/", 0).collect()
    assert all(r["r"] is None for r in div)
    assert X.normalize_column_names(spark.createDataFrame([(1,)], "`Image Column` int")).columns == ["image_column"]
    assert X.normalize_column_name("ImageColumn") == "imcol"


def test_joins_and_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "k int, v string")
    full = J.output_join(a, b, ["k"], "outer")
    assert sorted(full.columns) == ["k", "v", "v_right"] and full.count() == 3
    assert J.output_join(a, None, ["k"]) is a and J.output_join(None, b, ["k"]) is None
    assert J.output_join(a, b.withColumnRenamed("k", "z"), ["k"]) is a
    u = J.union_diagonal([a, spark.createDataFrame([(3, 1.5)], "k int, w double")])
    assert u.count() == 3 and set(u.columns) == {"k", "v", "w"}
    conflict = J.union_diagonal([a, spark.createDataFrame([(3, 7)], "k int, v int")])
    assert dict(conflict.dtypes)["v"] == "string"
    pos = J.row_position(spark.range(0, 1000).repartition(5), ["id"]).collect()
    assert all(r["__pos"] == r["id"] + 1 for r in pos)
    kept, stats = J.dedup_keep_first(spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")],
                                                           "k int, o int, v string"), ["k"], ["o"])
    assert {r["k"]: r["v"] for r in kept.collect()} == {1: "a", 2: "c"}
    assert stats.first()["dropped"] == 1


def test_running_sum_matches_window(spark):
    rows = [(0 if i % 2 else i % 5, i, float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, o int, v double")
    got = {(r["g"], r["o"]): r["running"] for r in SO.running_sum(df, ["g"], ["o"], "v", num_chunks=6).collect()}
    acc = {}
    for g, o, v in sorted(rows, key=lambda x: (x[0], x[1])):
        acc[g] = acc.get(g, 0.0) + v
        assert got[(g, o)] == pytest.approx(acc[g])


def test_aggregates(spark):
    df = spark.createDataFrame([("w1", 1, 10.0), ("w1", 2, 12.0), ("w2", 1, 20.0)], "wafer string, o int, cd double")
    g = {r["wafer"]: r for r in A.config_groupby(df, ["wafer"], {"cd": "mean", "o": "count"}).collect()}
    assert g["w1"]["cd_mean"] == 11.0 and g["w1"]["o_count"] == 2
    assert A.config_groupby(df, ["nope"], {"cd": "mean"}) is df
    fl = {r["wafer"]: r["cd"] for r in A.config_groupby(df, ["wafer"], {"cd": "last"}, order_col="o").collect()}
    assert fl == {"w1": 12.0, "w2": 20.0}
    assert A.parse_grouping("by_side_wafer") == ["side", "wafer"] and A.parse_grouping("by_lot") == ["lot"]
    ts = {r["column_name"]: r for r in A.table_stats(df.limit(1)).collect()}
    assert ts["cd"]["std"] == 0.0
    k = A.kpi(df, "CD", "sum").first()
    assert k["text"] == "42.00"
    h = A.histogram(df, "cd", 2).collect()
    assert sum(r["count"] for r in h) == 3
    cov = A.coverage(spark.createDataFrame([], "k string"), spark.createDataFrame([], "k string"), "k").first()
    assert cov["coverage_pct"] == 100.0 and cov["status"] == "green"
