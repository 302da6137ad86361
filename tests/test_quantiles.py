import random

import pytest

from quarry.functions import exact_quantile as EQ
from quarry.functions.quantiles import quantiles


def _linear(vals, p):
    s = sorted(vals)
    h = p * (len(s) - 1)
    lo, hi = int(h // 1), int(-(-h // 1))
    return s[lo] if lo == hi else (hi - h) * s[lo] + (h - lo) * s[hi]


def test_refinement_matches_sorted_reference(spark, monkeypatch):
    # force several refinement passes on a small column
    monkeypatch.setattr(EQ, "FINAL_ROWS", 50)
    monkeypatch.setattr(EQ, "BUCKETS", 8)
    rnd = random.Random(7)
    vals = [rnd.lognormvariate(0, 2) for _ in range(3000)] + [5.0] * 1000  # skew + a hot value
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = quantiles(df, "x", probs)
    for p, g in zip(probs, got):
        assert g == pytest.approx(_linear(vals, p), rel=1e-12, abs=1e-12)
    assert got == quantiles(df, "x", probs, method="percentile")


def test_empty_and_constant(spark):
    assert quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]
    assert quantiles(spark.createDataFrame([(2.0,)] * 10, "x double"), "x", [0.1, 0.9]) == [2.0, 2.0]


def test_group_quantiles_match_percentile(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(EQ, "FINAL_ROWS", 40)
    monkeypatch.setattr(EQ, "BUCKETS", 8)
    rnd = random.Random(3)
    rows = [("hot", rnd.gauss(0, 1)) for _ in range(2000)] + [("hot", 1.5)] * 500 + \
        [("small", float(i)) for i in range(7)] + [("const", 2.0)] * 100
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.25, 0.5, 0.75]
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in EQ.group_quantiles(df, ["g"], "x", probs).collect()}
    want = {r["g"]: tuple(r["q"]) for r in df.groupBy("g").agg(
        F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12)
    whole = EQ.group_quantiles(df, [], "x", [0.5]).first()[0]
    assert whole == pytest.approx(df.select(F.percentile("x", 0.5)).first()[0])


def test_nearest_interpolation(spark):
    vals = [float(v) for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, 100)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    # n = 10: rank round(0.25 * 9) = round(2.25) = 2 -> 3.0; round(0.75 * 9) = round(6.75) = 7 -> 8.0
    assert quantiles(df, "x", [0.25, 0.75], method="nearest") == [3.0, 8.0]
