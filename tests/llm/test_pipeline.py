import os
import random
import tempfile
from collections import defaultdict

import numpy as np
import pytest
from test_jaccard import brute as groups_of
from test_line_dedup import brute as deduped

import corpus_pipeline as C
from quarry.llm import packing as P
from quarry.llm import quality as Q


def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(rnd.randint(8, 14))) + "."
    shared = [line() + " and so on" for _ in range(3)]
    rows = []
    for i in range(150):
        if i % 4 == 0:
            text = rnd.choice([" ".join([word()] * 40), " ".join(word().upper() + "!!" for _ in range(40))])
        else:
            text = "\n".join(rnd.choice(shared) if rnd.random() < 0.25 else line() for _ in range(rnd.randint(1, 9)))
        rows.append((i, text, "en", f"src{i % 6}", len(text)))
    for i in range(150, 190):
        of = rows[rnd.randrange(150)]
        words = of[1].split(" ")
        words[rnd.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words), "en", None, 1))
    rows += [(200, None, None, "src0", None), (201, "", "en", "src1", 0), (202, line() * 3000, "en", "src2", 5), rows[1]]
    return rows, [(i, int(i % 4 > 0), 0) for i in range(0, 150)]


@pytest.fixture(scope="module")
def folder(spark):
    d = tempfile.mkdtemp(prefix="quarry-test-")
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    for name, stage in C.STAGES:
        out = C.write_table(stage(spark, docs, folder), "test")
        got = [tuple(r) for r in out.collect()]
        if name != "packing":
            assert out.columns == columns
        key = lambda r: repr(r)
        if name == "quality_classifier":
            model = Q.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            p = model.score(np.array([Q.features(r[1]) for r in rows]))
            assert sorted(got, key=key) == sorted((r for r, x in zip(rows, p) if x >= 0.5), key=key)
            assert not any(r[0] < 150 and r[0] % 4 == 0 for r in got) and sum(r[0] < 150 for r in got) >= 110
        elif name == "line_dedup":
            text = defaultdict(list)
            for i, _, dropped, kept in deduped([r[:2] for r in rows], 40, 5):
                text[i].append((dropped, kept))
            assert len(got) == len(rows)
            for r in got:
                before = next(x for x in rows if x[0] == r[0])
                dropped, kept = text[r[0]][0]
                assert r[1:] == (kept if dropped else before[1], before[2], before[3], len(kept) if dropped else r[4])
            assert any(d for v in text.values() for d, _ in v)
        elif name == "near_duplicates":
            keep = {i for i, _, c in groups_of([r[:2] for r in rows], 5, 80, 100) if i == c}
            assert sorted(got, key=key) == sorted({(r[0], r[1]): r for r in rows if r[0] in keep}.values(), key=key) and len(got) < len(rows)
        elif name == "mixing":
            assert sorted(got, key=key) == sorted(rows, key=key)
        else:
            tok = P.WordTokenizer(C.word_tokenizer())
            pieces, places = defaultdict(int), defaultdict(list)
            for r in out.collect():
                pieces[r.doc_id] += r.length
                places[r.sequence_id].append((r.offset, r.length))
            assert pieces == {r[0]: len(tok.ids(r[1] or "")) // 4 + 1 for r in rows}
            for s in places.values():
                ends = [0]
                for o, n in sorted(s):
                    assert o == ends[-1]
                    ends.append(o + n)
                assert ends[-1] <= 4096
        docs, rows = out, got
    assert C.run(spark, folder).count() == len(rows)


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = C.write_table(stage(spark, docs, folder), "test")
        assert docs.count() == 0


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert [n for n in range(1, 14) if sum(k.startswith(f"op{n}_") for k in names) != 1] == [] and names["pipeline"] is C.run
    assert os.path.exists(C.word_tokenizer())


def test_mixture_decides_the_packed_rows(spark, folder, monkeypatch):
    from quarry.llm.mixing import mix

    monkeypatch.setattr(C, "STAGES", C.STAGES[3:])
    rows = [tuple(r) for r in C.run(spark, folder).collect()]
    monkeypatch.setattr(C, "MIX_WEIGHTS", {"src0": 1, "src1": 30, "src2": 1, "src3": 1})
    packed = C.run(spark, folder)
    other = [tuple(r) for r in packed.collect()]
    assert sorted((r[:5] for r in rows), key=repr) == sorted((r[:5] for r in other), key=repr) and sorted(rows, key=repr) != sorted(other, key=repr)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id <> 1")  # id 1 is there twice
    at = {r.doc_id: r.position for r in mix(docs, C.MIX_WEIGHTS, C.MIX_REST).collect()}
    first = {}
    for r in P.pack_documents(mix(docs, C.MIX_WEIGHTS, C.MIX_REST), C.word_tokenizer(), position_col="position").collect():
        assert r.position == at[r.doc_id]
        first[r.sequence_id] = min(first.get(r.sequence_id, (1 << 60, 0)), (r.position, r.piece))
    assert sorted(first) == list(range(len(first))) and [first[i] for i in range(len(first))] == sorted(first.values())


def near(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, class string"
    return sorted((r.doc_id, r.text) for r in C.near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in rows], schema), "").collect())


def test_rows_of_one_id_go_by_their_own_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    assert near(spark, [(1, a), (1, b), (2, a), (3, c)]) == [(1, a), (1, b), (3, c)]
    assert near(spark, [(1, a), (2, b), (2, a), (3, c)]) == [(1, a), (2, b), (3, c)]
    # one row of each group, also where its id has several rows in it
    assert near(spark, [(1, a), (1, a), (1, a + " z"), (2, b), (3, b)]) in ([(1, a), (2, b)], [(1, a + " z"), (2, b)])
    # clean texts under one id, texts without words, and null ids all stay
    kept = [(1, a), (1, b), (1, c), (4, ""), (4, " ")]
    assert near(spark, kept) == sorted(kept)
    assert len(near(spark, [(5, None), (5, None), (6, a)])) == 3
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    null_ids = spark.createDataFrame([(None, a, "en", "s", 1), (None, a, "en", "s", 1), (7, a, "en", "s", 1)], schema)
    assert C.near_duplicates(spark, null_ids, "").count() == 3
