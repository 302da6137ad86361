import random
from collections import defaultdict

import pytest

from quarry.llm import line_dedup as L

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars, min_docs):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holds = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for s in (t or "").split("\n"):
                if len(key(s)) >= min_chars:
                    holds[key(s)].add(i)
    owner = {k: max(v) for k, v in holds.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        s = (t or "").split("\n")
        kept = [x for x in s if i is None or owner.get(key(x), i) == i]
        out.append((i, len(s), len(s) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fan_in", [(1, 3), (5, 2)])
def test_against_brute_force(spark, batches, fan_in):
    rnd = random.Random(batches)
    pool = ["Shared line number one", "shared LINE number one  ", "\tÉcole Shared\r", "école shared", "École shared", "other words here", "x", ""]
    rows = [(i, "\n".join(rnd.choice([*pool, f"own {i}"]) for _ in range(rnd.randint(1, 9)))) for i in range(60)]
    rows += [(3, rows[3][1]), (3, "shared line number one\nb"), (None, "Shared line number one"), (None, None), (70, None), (71, ""), (72, "Shared line number one\n" * 500)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, n_lines string")
    got = L.dedup_lines(df, min_chars=6, min_docs=4, batches=batches, fan_in=fan_in)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept_text"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=repr) == brute(rows, 6, 4)


def test_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_find_what_is_new(spark):
    runs = L.LineRuns(spark, fan_in=2)
    for rows in ([(1, 1, 2, 90), (2, 2, 1, 80)], [(1, 1, 4, 70), (3, 3, 1, 60)], [(3, 3, 1, 50), (1, 1, 1, 40)]):
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, n_docs long, owner long"))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert sorted(map(tuple, runs.totals().collect())) == [(1, 1, 7, 90), (2, 2, 1, 80), (3, 3, 2, 60)]


def test_a_text_of_a_million_lines(spark):
    """Time grows with a text, not with its square: one common line among a million."""
    import time

    common = "a line of more than forty characters that five documents hold"
    rows = [(i, common) for i in range(5)] + [(-1, "\n".join(["x"] * 500_000 + [common] + ["y"] * 500_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in L.dedup_lines(df).collect()}
    assert time.time() - began < 60
    assert (got[-1].n_lines, got[-1].n_dropped) == (1_000_001, 1) and got[-1].kept_text == "\n".join(["x"] * 500_000 + ["y"] * 500_000)
    assert got[4].kept_text == common and got[3].kept_text == ""


def test_runs_leave_the_catalog(spark, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(L.LineRuns, "totals", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        L.dedup_lines(spark.createDataFrame([(1, "some line")], "doc_id long, text string"))
    assert {t.name for t in spark.catalog.listTables()} == before
