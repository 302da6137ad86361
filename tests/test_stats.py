import math

import pytest

from pyspark.sql import functions as F

from quarry.functions.fdist_expr import f_sf_expr, norm_ppf_expr
from quarry.operators import stats as ST


def _one_way(spark):
    rows = [("A", 10.0), ("A", 12.0), ("A", 11.0), ("B", 20.0), ("B", 22.0), ("B", 21.0),
            ("C", 15.0), ("C", 17.0), ("C", 16.0)]
    return spark.createDataFrame(rows, "factor_a string, response double")


def _tails(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, f double, d1 double, d2 double")
    return [r[0] for r in df.orderBy("i").select(f_sf_expr(F.col("f"), F.col("d1"), F.col("d2"))).collect()]


def test_f_tail_known_value(spark):
    got = _tails(spark, [(75.0, 2.0, 6.0), (1.0, 5.0, 5.0), (0.0, 3.0, 7.0), (None, 3.0, 7.0)])
    assert got[0] == pytest.approx(5.6896e-05, rel=1e-4)
    assert got[1] == pytest.approx(0.5, abs=1e-12)
    assert got[2] == 1.0
    assert got[3] is None


def test_f_tail_closed_forms_at_any_size(spark):
    # d1 = 2: (1 + 2 f / d2) ** (-d2 / 2); d2 = 2: 1 - (d1 f / (2 + d1 f)) ** (d1 / 2)
    cases = [(f, 2.0, d2) for f in (0.01, 0.5, 3.0, 40.0) for d2 in (1.0, 7.0, 1e3, 1e6, 1e8, 1e10, 1e12)]
    for (f, _, d2), p in zip(cases, _tails(spark, cases)):
        assert p == pytest.approx(math.exp(-d2 / 2 * math.log1p(2 * f / d2)), rel=1e-9), (f, d2)
    cases = [(f, d1, 2.0) for f in (0.5, 3.0, 40.0) for d1 in (1.0, 9.0, 500.0)]
    for (f, d1, _), p in zip(cases, _tails(spark, cases)):
        assert p == pytest.approx(-math.expm1(d1 / 2 * math.log(d1 * f / (2 + d1 * f))), rel=1e-9), (f, d1)
    # F(d, d) has median 1, however large d is
    assert _tails(spark, [(1.0, d, d) for d in (3.0, 1e3, 1e5)]) == pytest.approx([0.5] * 3, rel=1e-8)


def test_norm_ppf(spark):
    got = spark.createDataFrame([(0, 0.975), (1, 0.5)], "i int, p double").orderBy("i").select(norm_ppf_expr(F.col("p"))).collect()
    assert got[0][0] == pytest.approx(1.959963985, abs=1e-8)
    assert got[1][0] == pytest.approx(0.0, abs=1e-12)


def test_one_way_known_answers(spark):
    t = {r["source"]: r for r in ST.anova(_one_way(spark), ["factor_a"], "response").collect()}
    assert t["factor_a"]["ss"] == pytest.approx(150.0)
    assert t["Residual"]["ss"] == pytest.approx(6.0)
    assert t["Total"]["ss"] == pytest.approx(156.0)
    assert (t["factor_a"]["df"], t["Residual"]["df"], t["Total"]["df"]) == (2, 6, 8)
    assert t["factor_a"]["f"] == pytest.approx(75.0)
    assert t["factor_a"]["p_value"] == pytest.approx(5.6896e-05, rel=1e-4)
    assert t["factor_a"]["significant"] is True
    assert t["factor_a"]["variance_pct"] / 100 == pytest.approx(0.9615, abs=1e-4)


def test_no_effect_not_significant(spark):
    rows = [(g, v) for g, vals in (("a", [1.0, 2.0, 3.0, 4.0]), ("b", [1.5, 2.5, 3.5, 2.0]),
                                   ("c", [2.0, 3.0, 1.0, 4.0])) for v in vals]
    df = spark.createDataFrame(rows, "g string, y double")
    t = {r["source"]: r for r in ST.anova(df, ["g"], "y").collect()}
    assert t["g"]["p_value"] > 0.05 and t["g"]["significant"] is False


def test_two_way_and_effect_sizes(spark):
    rows = []
    for a_i, a in enumerate(["a1", "a2"]):
        for b_i, b in enumerate(["b1", "b2", "b3"]):
            for rep in range(2):
                rows.append((a, b, 10.0 + 3 * a_i + b_i + 0.5 * rep + (a_i * b_i)))
    df = spark.createDataFrame(rows, "factor_a string, factor_b string, y double")
    t = {r["source"]: r for r in ST.anova(df, ["factor_a", "factor_b"], "y").collect()}
    assert set(t) == {"factor_a", "factor_b", "factor_a:factor_b", "Residual", "Total"}
    assert t["factor_a:factor_b"]["df"] == 2 and t["Residual"]["df"] == 12 - 5 - 1
    total_share = sum(r["variance_pct"] for s, r in t.items() if s != "Total")
    assert total_share == pytest.approx(100.0, abs=1e-6)
    es = ST.effect_sizes(ST.anova(df, ["factor_a", "factor_b"], "y")).collect()
    assert all(0 <= r["eta_squared"] <= 1 for r in es)


def test_identical_factors_exceed_100(spark):
    rows = [("x" if i < 6 else "y", "x" if i < 6 else "y", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "a string, b string, y double")
    t = ST.anova(df, ["a", "b"], "y")
    chk = ST.variance_check(t).collect()[0]
    assert chk["ok"] is False and chk["variance_sum"] > 100
    with pytest.raises(ValueError):
        ST.variance_check(t, on_fail="raise")


def test_null_response_dropped_and_missing_columns(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), ("b", 5.0)], "g string, y double")
    t = {r["source"]: r for r in ST.anova(df, ["g"], ["y", "not_there"]).collect()}
    assert t["Total"]["df"] == 2
    with pytest.raises(ValueError):
        ST.anova(df, ["g"], ["nope"])


def test_chart_data(spark):
    df = _one_way(spark)
    me = {r["level"]: r for r in ST.main_effects(df, ["factor_a"], "response").collect()}
    assert me["A"]["mean"] == pytest.approx(11.0) and me["A"]["grand_mean"] == pytest.approx(16.0)
    assert me["A"]["se"] == pytest.approx(1.0 / math.sqrt(3))
    hist = ST.residual_histogram(df, ["factor_a"], "response", 30).collect()
    assert sum(r["count"] for r in hist) == 9
    qq = ST.qq_points(df, ["factor_a"], "response").orderBy("rank").collect()
    assert [r["rank"] for r in qq] == list(range(1, 10))
    assert qq[0]["theoretical"] < 0 < qq[-1]["theoretical"]


def test_roles_copy_no_row_per_column(spark):
    """F8: a column is counted on its own; nulls, NaN and both zeros as in a distinct count."""
    df = spark.createDataFrame([(i, float("nan") if i % 3 else -0.0 if i % 2 else 0.0, None if i % 4 else "x", None) for i in range(24)], "a int, b double, c string, d string")
    got = ST.detect_roles(df)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("a", "response", 24, 24), ("b", "response", 2, 24), ("c", "factor", 1, 6), ("d", "factor", 0, 0)]
    assert {r["non_null"] for r in ST.detect_roles(df.limit(0)).collect()} == {0}
