import numpy as np
import pytest

from quarry.llm import vector_dedup as V


def brute(rows, threshold):
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if i is not None and g is not None and usable(v) else None for i, v, g in rows]
    links, group = [set() for _ in rows], list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j)
                links[j].add(i)
                group[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(links[i]), low.get(find(i)), r[0] is None or r[0] == low[find(i)]) for i, r in enumerate(rows)), key=repr)


def clusters(seed, dim=24):
    rnd = np.random.default_rng(seed)
    rows, i = [], 0
    for label, sizes in enumerate(([120, 60, 3, 2, 2], [1] * 150 + [2] * 10 + [30], [2])):
        for n in sizes:
            c = rnd.normal(size=dim)
            for _ in range(n):
                rows.append((i * 3 % 2003, (c + 0.15 * rnd.normal(size=dim)).astype(np.float32).tolist(), label))
                i += 1
    return rows


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 25)])
def test_against_brute_force(spark, seed, block):
    rows = clusters(seed)
    rows += [(3000 + i, rows[5][1], rows[5][2]) for i in range(9)] + [(3100, rows[5][1], 1), (3101, rows[5][1], None), (3102, None, 0), (3103, [], 0), (3104, [0.0] * 24, 0),
                                                                     (3105, [float("nan")] * 24, 0), (3106, [None] * 24, 0), (3107, [float("inf")] * 24, 0), (3108, [1.0, 2.0], 0), (None, rows[5][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = sorted(map(tuple, V.near_duplicates(df, leaf=40, block=block).collect()), key=repr)
    assert got == brute(rows, V.THRESHOLD)


def test_saturated_lists_still_find_a_neighbouring_group(spark):
    # two tight groups, each larger than the lists, linked only with each other's nearer half
    rnd = np.random.default_rng(0)
    a = np.zeros(16)
    a[0] = 1
    b = np.zeros(16)
    b[:2] = np.cos(0.36), np.sin(0.36)
    rows = [(i, (c + 0.01 * rnd.normal(size=16)).tolist(), 1) for i, c in enumerate([a] * 40 + [b] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, V.near_duplicates(df, neighbours=4, leaf=10, trees=2).collect()), key=repr)
    assert got == brute(rows, V.THRESHOLD)


def test_empty_and_lone(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert V.near_duplicates(none).count() == 0
    one = spark.createDataFrame([(4, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert tuple(V.near_duplicates(one).first()) == (4, 0, 4, True)


def _nodes(spark, vectors):
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    return V.nodes_of(df, "vec_id", "embedding", "label")


def test_audit_of_rare_links_is_not_empty(spark):
    # one node in 250 has a link, and none was found
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(2000, 48))
    for i in range(4):
        x[2 * i + 1] = x[2 * i] + 0.01 * rnd.normal(size=48)
    nodes, kind = _nodes(spark, x)
    none, lists = spark.createDataFrame([], "node long, component long"), spark.createDataFrame([], "u long, v long, sim double")
    assert V.audit(nodes, lists, none, kind, V.THRESHOLD, 200) == (0, 0)
    found = spark.createDataFrame([(2 * i + j, 2 * i) for i in range(3) for j in range(2)], "node long, component long")
    assert V.audit(nodes, lists, found, kind, V.THRESHOLD, 200) == (0.75, 0.75)
    assert V.audit(nodes.where("id >= 8"), lists, none, kind, V.THRESHOLD, 200) == (1, 1)  # all were compared


def test_audit_counts_nodes_not_links(spark):
    # a large cluster was found whole, the pairs beside it were not
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 48))
    x[:100] = x[0] + 0.01 * rnd.normal(size=(100, 48))
    x[200:] = x[100:200] + 0.01 * rnd.normal(size=(100, 48))
    nodes, kind = _nodes(spark, x)
    found = spark.createDataFrame([(i, 0) for i in range(100)], "node long, component long")
    lists = spark.createDataFrame([(i, (i + 1) % 100, 0.99) for i in range(100)] + [(100, 101, 0.9)], "u long, v long, sim double")
    assert V.audit(nodes, lists, found, kind, V.THRESHOLD, 300, block=64)[0] == pytest.approx(1 / 3)
    share, low = V.audit(nodes, lists, found, kind, V.THRESHOLD, 40, block=64)
    assert low < share < 0.7  # strata by their sizes, with a sample's doubt


def test_rounds_go_on_while_lists_are_fresh(spark, monkeypatch):
    rounds = []
    refined = V._refined

    def kept(rows, comp, k):
        out = refined(rows, comp, k)
        rounds.append(out)
        return out

    seen = []
    monkeypatch.setattr(V, "_refined", kept)
    monkeypatch.setattr(V, "audit", lambda *a, **k: seen.append(rounds[-1].where("fresh").count()) or (1.0, 1.0))
    rnd = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rnd.normal(size=(400, 12)))], "vec_id long, embedding array<double>, label int")
    V.near_duplicates(df, neighbours=6, leaf=10, trees=1)
    assert seen == [0]


def test_lists_that_do_not_settle_are_audited(spark, monkeypatch):
    """At the bound of rounds the audit decides; it does not raise."""
    monkeypatch.setattr(V, "MAX_ROUNDS", 1)
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(300, 16))
    x[150:] = x[:150] + 0.01 * rnd.normal(size=(150, 16))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in V.near_duplicates(df, neighbours=4, leaf=10, trees=2).collect()}
    assert sum(got[i].component_id == i - 150 for i in range(150, 300)) >= 147
