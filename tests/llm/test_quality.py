import random

import numpy as np
import pytest

from quarry.llm import quality as Q


def test_features():
    f = dict(zip(Q.FEATURES, Q.features("The cat, the CAT cat cat !\nThe 12 é")))
    assert f["repeated_neighbours"] == 1 / 10 and f["digits"] == 2 / 36 and f["exclaims"] == 1 / 36
    assert f["longest_repeat"] == pytest.approx(np.log(2)) and f["distinct_lines"] == 1
    assert Q.features(None) == Q.features("") and not any(Q.features(""))


def test_pairs_learn_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone, pairs = Q.fit(x, y, rounds=60, pairs=0), Q.fit(x, y, rounds=60, pairs=2)
    test = rnd.random((2000, 3))
    want = (test[:, 0] > 0.5) ^ (test[:, 1] > 0.5)
    assert ((alone.score(test) >= 0.5) == want).mean() < 0.65 < 0.95 < ((pairs.score(test) >= 0.5) == want).mean()
    assert pairs.pairs[0][:2] == (0, 1)


def test_scores_are_sums_of_lookups():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(500, 4))
    m = Q.fit(x, (x[:, 0] + x[:, 2] > 0).astype(float), rounds=20, pairs=1)
    for row, p in zip(x[:20], m.score(x[:20])):
        total = m.intercept + sum(t[int((c <= v).sum())] for v, c, t in zip(row, m.cuts, m.tables))
        total += sum(t[int((m.coarse[a] <= row[a]).sum()), int((m.coarse[b] <= row[b]).sum())] for a, b, t in m.pairs)
        assert p == pytest.approx(1 / (1 + np.exp(-total)))


def test_held_out_accuracy_and_edges(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rnd.randint(5, 80))) + "."
    bad = lambda: rnd.choice([lambda: " ".join([word()] * 30), lambda: " ".join(word().upper() + "!!" for _ in range(30))])()
    rows = [(i, good() if i % 3 else bad(), 0) for i in range(600)]
    docs = spark.createDataFrame(rows + [(700, None, 0), (701, "", 0), (None, "x", 0), (702, "ok " * 50_000, 0), (5, "dup", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 600, 2)] + [(None, 1), (800, 0), (9, None), (11, 7)], "doc_id long, quality int")
    m = Q.train(docs, labels, max_rows=250)
    got = Q.score(docs, m).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 2 and r.doc_id != 5]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    kept = Q.keep_good(docs, m)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    empty = Q.train(docs.limit(0), labels)
    assert Q.score(docs.limit(3), empty).first().score == 0.5 and Q.score(docs.limit(0), m).count() == 0


def test_the_sample_is_bounded_where_an_id_has_many_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert Q.training_rows(docs, labels, "quality", max_rows=10).count() == 10
    assert Q.training_rows(docs, labels, "quality", max_rows=1000).count() == 501


def test_whole_scored_table_against_plain_code(spark):
    """Every row of the scored table from the fitted tables, one feature and one pair at a time."""
    rnd = random.Random(12)
    texts = [" ".join(rnd.choice(["good", "Words", "x9", "!!", "\n", "é,"]) for _ in range(rnd.randint(0, 60))) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame([(i % 140, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 140, 3)], "doc_id long, quality int")
    m = Q.train(docs, labels)

    def plain(text):
        x, total = Q.features(text), m.intercept
        for v, cuts, t in zip(x, m.cuts, m.tables):
            total += t[sum(1 for c in cuts if c <= v)]
        for a, b, t in m.pairs:
            total += t[sum(1 for c in m.coarse[a] if c <= x[a]), sum(1 for c in m.coarse[b] if c <= x[b])]
        return 1 / (1 + np.exp(-total))

    want = sorted((i % 140, plain(t)) for i, t in enumerate(texts))
    got = sorted((r.doc_id, r.score, r.predicted) for r in Q.score(docs, m).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] == pytest.approx(w[1], abs=1e-12) and g[2] == int(g[1] >= 0.5) for g, w in zip(got, want))
