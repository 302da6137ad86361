import random

import numpy as np
import pytest

from quarry.llm import langid as L


def test_gradients_by_finite_differences():
    rnd = np.random.default_rng(0)
    net = L.BiGRU(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, label = rnd.integers(0, 5, (7, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = net.gradients(data, label)
    for name, p in net.p.items():
        for _ in range(8):
            i = tuple(rnd.integers(0, min(s, 5) if name == "x" and j == 1 else s) for j, s in enumerate(p.shape))
            old, e = p[i], 1e-3
            p[i] = old + e
            up = net.gradients(data, label)[0]
            p[i] = old - e
            down = net.gradients(data, label)[0]
            p[i] = old
            assert (up - down) / (2 * e) == pytest.approx(g[name][i], rel=2e-2, abs=2e-5)


def texts(n, seed):
    rnd = random.Random(seed)
    words = {"aa": ["banana", "anagram", "abracadabra", "salad"], "oo": ["boot", "room", "zoo", "foolproof"], "ÿÿ": ["ñoño", "año", "señor", "piña"]}
    return [(i, " ".join(rnd.choice(words[l]) for _ in range(rnd.randint(3, 60))), l) for i, l in enumerate(rnd.choice([*words]) for _ in range(n))]


def test_held_out_accuracy_and_edges(spark):
    df = spark.createDataFrame(texts(400, 1) + [(900, "no language", None), (901, None, "aa"), (902, "123 4", "aa")], "doc_id long, text string, lang string")
    net = L.train(df, per_language=80, steps=60, window=32)
    assert net.labels == sorted(["aa", "oo", "ÿÿ"])
    test = texts(100, 2)
    rows = [(i, t, 0) for i, t, _ in test] + [(500, None, 0), (501, "", 0), (502, "12 34 !", 0), (503, "zoo " * 40_000, 0), (503, "zoo", 0), (None, "banana", 0)]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, score int"), net, window=32).collect()
    by = {r.doc_id: r for r in got if r.doc_id != 503}
    assert len(got) == len(rows)
    assert np.mean([by[i].lang_pred == l for i, _, l in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and by[None].lang_pred == "aa"
    assert {r.lang_pred for r in got if r.doc_id == 503} == {"oo"}
    spans = L.label_spans(net, "banana salad anagram " * 3 + "zoo room boot foolproof " * 3, window=32)
    assert spans[0][2] == "aa" and spans[-1][2] == "oo" and spans[-1][1] == len("banana salad anagram " * 3 + "zoo room boot foolproof " * 3)


def test_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    net = L.train(none)
    assert L.identify(spark.createDataFrame([(1, "text")], "doc_id long, text string"), net).first().lang_pred == "und"
    assert L.identify(none, net).count() == 0
