import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import matching as M
from quarry.operators import quality as Q
from quarry.operators import similarity as SM


def test_graph_traversals(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "y")], "src string, dst string")
    nb = {r["neighbor"]: r["direction"] for r in G.neighbors(edges, "b").collect()}
    assert nb == {"c": "outgoing", "a": "incoming"}
    hop = {r["node"]: r["depth"] for r in G.k_hop(edges, ["a"], 1).collect()}
    assert hop == {"a": 0, "b": 1, "d": 1}
    lin = {r["node"]: r["depth"] for r in G.lineage(edges.withColumnsRenamed({"src": "parent", "dst": "child"}),
                                                   "a", "down").collect()}
    assert lin == {"b": 1, "c": 2, "d": 3}  # the cycle back to a stops
    up = {r["node"] for r in G.lineage(edges.withColumnsRenamed({"src": "parent", "dst": "child"}), "c", "up").collect()}
    assert up == {"b", "a", "d"}
    cat = spark.createDataFrame([("d2", ["d1"]), ("d3", ["d1", "d2"])], "id string, parent_ids array<string>")
    assert G.edges_from_parents(cat).count() == 3


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, 5.0, "A"), (2, None, "B"), (3, 50.0, "Z"), (3, 7.0, None)],
                               "id int, v double, c string")
    vc = {(r["rule"], r["column_name"]): r["violations"] for r in
          Q.value_constraints(df, {"v": {"min": 6, "max": 40, "not_null": True}, "c": {"regex": "^[AB]$"}}).collect()}
    assert vc == {("below_min", "v"): 1, ("above_max", "v"): 1, ("not_null", "v"): 1, ("regex", "c"): 1}
    sr = {(r["rule"], r["column_name"]): r["violations"] for r in
          Q.schema_rules(df, required=["id", "zz"], types={"v": "float", "c": "int"}, unique=["id", "c"]).collect()}
    assert sr[("required", "zz")] == 1 and sr[("type_float", "v")] == 0 and sr[("type_int", "c")] == 1
    assert sr[("unique", "id")] == 1 and sr[("unique", "c")] == 0  # null counts as one value
    rr = Q.row_rules(df, [{"name": "pos", "expr": "v > 0 OR c = 'A'", "on_fail": "error"}]).first()
    assert rr["violations"] == 1  # the null row fails
    good, bad = Q.quarantine_split(df, {"v_ok": "v BETWEEN 0 AND 40", "c_ok": F.col("c").isNotNull()})
    assert good.count() == 1 and bad.count() == 3
    assert sorted(bad.filter("id = 3 AND c IS NULL").first()["failed_rules"]) == ["c_ok"]
    ag = {r["rule"]: r["passed"] for r in Q.aggregate_rules(df, [{"type": "row_count", "min": 5},
                                                                  {"type": "null_ratio", "column": "v", "max": 0.5}]).collect()}
    assert ag == {"row_count": False, "null_ratio": True}
    with pytest.raises(ValueError):
        Q.stable_columns(df, ["id", "v", "q"], mode="error")
    assert Q.stable_columns(df, ["id"], mode="warn", subset=True) == []
    chk = {r["check"]: r["passed"] for r in Q.factor_levels_check(df, ["c"], "v", min_rows=3).collect()}
    assert chk["min_rows"] and chk["levels_c"] and chk["numeric_response"]


def test_similarity_matches_bruteforce(spark):
    docs = [(1, "g", "alpha beta gamma delta"), (2, "g", "alpha beta gamma epsilon"), (3, "g", "zeta eta theta"),
            (4, "g", "alpha beta"), (5, "h", "alpha beta gamma delta")]
    rows = [(d, g, t) for d, g, text in docs for t in sorted(set(text.split()))]
    toks = spark.createDataFrame(rows, "doc long, grp string, token string")
    got = {(r["a"], r["b"]): r["jaccard"] for r in SM.jaccard_pairs(toks, 0.4).collect()}
    sets = {d: (g, set(t.split())) for d, g, t in docs}
    want = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a][0] == sets[b][0]:
                j = len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1])
                if j >= 0.4:
                    want[(a, b)] = j
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
    links = spark.createDataFrame([(1, 3), (1, 2)], "source long, target long")
    au = {(r["source"], r["target"]): r["status"] for r in SM.link_audit(toks, links, 0.4, 0.05).collect()}
    assert au[(1, 3)] == "questionable" and au[(1, 2)] == "valid" and au[(1, 4)] == "missing"


def test_similarity_in_cells_of_blocks(spark, monkeypatch):
    """blocks of a few documents, stretches shorter than a document's hits, small groups that share a block."""
    import random

    for name, value in (("BLOCK_DOCS", 4), ("BLOCK_TOKENS", 40), ("HELD", 6)):
        monkeypatch.setattr(SM, name, value)
    rng = random.Random(3)
    sets = {d: ("g" if d < 15 else f"h{d % 4}", frozenset(rng.sample("abcdefghijkl", rng.randint(1, 9)))) for d in range(25)}
    toks = spark.createDataFrame([(d, g, t) for d, (g, s) in sets.items() for t in sorted(s)] + [(99, None, "a")], "doc long, grp string, token string")
    want = {(a, b): (len(s & u), len(s & u) / len(s | u)) for a, (g, s) in sets.items() for b, (h, u) in sets.items()
            if a < b and g == h and 20 * len(s & u) >= 3 * len(s | u)}
    assert {(r["a"], r["b"]): (r["overlap"], pytest.approx(r["jaccard"])) for r in SM.jaccard_pairs(toks, 0.15).collect()} == want
    links = spark.createDataFrame([(0, 1), (1, 500), (None, 2)], "source long, target long")
    got = {(r["source"], r["target"]): r["status"] for r in SM.link_audit(toks, links, 0.15, 0.05).collect()}
    assert got[(1, 500)] == got[(None, 2)] == "questionable" and {p for p, s in got.items() if s == "missing"} == want.keys() - {(0, 1)}


def plain_pairs(rows, num, den):
    """(a, b): overlap and Jaccard of two documents' rows, a token of several rows as often as on both sides."""
    from collections import Counter

    sets = {d: (g, Counter(t for e, _, t in rows if e == d)) for d, g, _ in rows}
    found = {}
    for a, (g, s) in sets.items():
        for b, (h, u) in sets.items():
            na, nb, overlap = sum(s.values()), sum(u.values()), sum(s[t] * u[t] for t in s)
            if a < b and g == h and overlap * (num + den) >= num * (na + nb) and min(na, nb) * den >= max(na, nb) * num:
                found[a, b] = overlap, pytest.approx(overlap / (na + nb - overlap))
    return found


@pytest.mark.parametrize("cost", [0, 10, 10**9])
def test_similarity_counts_by_hits_and_by_columns(spark, monkeypatch, cost):
    """no token, some or all of them are columns of a matrix product; a token of several rows; hashes that differ in their low bits only."""
    import random

    for name, value in (("BLOCK_DOCS", 5), ("BLOCK_TOKENS", 60), ("HELD", 40), ("DENSE", 50), ("HIT_COST", cost)):
        monkeypatch.setattr(SM, name, value)
    rng = random.Random(7)
    rows = [(d, "g" if d < 24 else "h", t) for d in range(30) for t in sorted(rng.sample("abcdefghijklmnop", rng.randint(1, 13)))]
    rows += rng.sample(rows, 20)
    got = SM.jaccard_pairs(spark.createDataFrame(rows, "doc long, grp string, token string"), 0.3).collect()
    assert {(r.a, r.b): (r.overlap, r.jaccard) for r in got} == plain_pairs(rows, 3, 10) and len(got) > 50
    near = np.array([7, 3, 5, 3, 1 << 40, 4, -9, 1 << 40], np.int64)
    assert SM._order(near).tolist() == np.argsort(near, kind="stable").tolist()


def test_similarity_blocks_of_sizes_too_far_apart_do_not_meet(spark, monkeypatch, tmpdir_path):
    """blocks follow sizes: ten documents of 2 tokens a block, ten of 40."""
    monkeypatch.setattr(SM, "BLOCK_DOCS", 10)
    rows = [(d, "g", f"w{(d * 7 + k) % 97}") for d in range(60) for k in range(2 if d % 2 else 40)]
    cells = SM._write_blocks(SM.token_sets(spark.createDataFrame(rows, "doc long, grp string, token string")), f"{tmpdir_path}/blocks", 3, 20).collect()
    long = [(c.x.split("-")[1], c.y.split("-")[1]) for c in cells if not c.x.startswith("short")]
    assert sorted(long) == [(str(i), str(j)) for i in range(6) for j in range(i, 6) if (i < 3) == (j < 3)]


def test_similarity_of_frequent_tokens(monkeypatch):
    """what all documents hold costs a column of a matrix product, not a hit a pair."""
    common, docs = 60, 400
    tokens = np.concatenate([np.concatenate([np.arange(common), [1000 + d]]) for d in range(docs)]).astype(np.int64)
    block = SM._Block(pa.array(range(docs)), pa.array(["g"] * docs), np.full(docs, common + 1), tokens)
    counted, bincount = [], np.bincount
    monkeypatch.setattr(SM.np, "bincount", lambda x, **kw: counted.append(len(x)) or bincount(x, **kw))
    found = [o for _, _, overlaps in SM._meet(block, block, True, 9, 10) for o in overlaps]
    assert found == [common] * (docs * (docs - 1) // 2) and sum(counted) <= docs


def test_link_audit_meets_blocks_of_like_sizes_only(spark, monkeypatch):
    """links that are missing come from the cells of the join, links given are compared whatever their sizes."""
    planned, write = [], SM._write_blocks
    monkeypatch.setattr(SM, "BLOCK_DOCS", 10)
    monkeypatch.setattr(SM, "_write_blocks", lambda *a: planned.append(write(*a)) or planned[-1])
    rows = [(d, "g", f"w{(d * 7 + k) % 97}") for d in range(60) for k in range(2 if d % 2 else 40)]
    tokens, links = spark.createDataFrame(rows, "doc long, grp string, token string"), spark.createDataFrame([(0, 1), (2, 4), (3, 500)], "source long, target long")
    got = {(r.source, r.target): (r.similarity, r.status) for r in SM.link_audit(tokens, links, 0.15, 0.05).collect()}
    want = {p: (jaccard, "missing") for p, (_, jaccard) in plain_pairs(rows, 3, 20).items() if p != (2, 4)}
    w = lambda d: {t for e, _, t in rows if e == d}
    linked = {(a, b): pytest.approx(len(w(a) & w(b)) / len(w(a) | w(b))) for a, b in ((0, 1), (2, 4), (3, 500))}
    assert got == want | {p: (s, "questionable" if p == (3, 500) else "valid") for p, s in linked.items()}
    assert planned[0].where("x NOT LIKE 'short%'").count() == 12  # of 21 pairs of six blocks


def test_name_matching(spark):
    cols = spark.createDataFrame([(0, "Wafer_ID"), (1, "cd_mean_nm"), (2, "side"), (3, "LWR_3sigma"), (4, "tool")],
                                 "pos int, name string")
    res = {r["target"]: (r["best"], r["tier"], r["confidence"]) for r in
           M.match_names(cols, "name", "pos", ["side", "cd", "roughness", "wafer", "tol", "nothing_like_it"],
                         aliases={"roughness": ["lwr"]}, rename_map={"Wafer_ID": "wafer"}).collect()}
    assert res["side"] == ("side", "exact", 1.0)
    assert res["cd"] == ("cd_mean_nm", "substring", 0.85)
    assert res["roughness"] == ("LWR_3sigma", "alias", 0.9)
    assert res["wafer"] == ("Wafer_ID", "exact", 1.0)
    assert res["tol"][0] == "tool" and res["tol"][1] == "fuzzy"
    assert res["nothing_like_it"][0] is None


def test_lineage_goes_as_deep_as_the_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(53)], "parent long, child long")
    got = {r["node"]: r["depth"] for r in G.lineage(edges, 0, "down").collect()}
    assert got == {i: i for i in range(1, 54)}
    assert G.lineage(edges, 0, "down", max_depth=3).count() == 3


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1000)] + [(7, 500), (1000, 3)], "parent long, child long")
    rounds = []
    kept = G.count

    def counted():
        for k in kept():
            rounds.append(k)
            yield k

    monkeypatch.setattr(G, "count", counted)
    got = {r.node: r.depth for r in G.lineage(edges, 0).collect()}
    assert len(rounds) <= 12 and got[7] == 7 and got[500] == 8 and got[499] == 499 and got[1000] == 508 and len(got) == 1000
    assert {r.node: r.depth for r in G.lineage(edges, 0, max_depth=9).collect()} == {**{i: i for i in range(1, 10)}, 500: 8, 501: 9}
    two = {r.node: r.depth for r in G.lineage(edges.where("parent < 50"), [0, 40], "down").collect()}
    assert two[45] == 5 and two[39] == 39
