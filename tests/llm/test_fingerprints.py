import hashlib
import random

from pyspark.sql import functions as F

from quarry.llm import fingerprints as P


def tree(text):
    """The fingerprint's definition in plain Python."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sections, shorts = [], []
    for s in text.split("\n\n"):
        digests, short = [], []
        for p in s.split("\n"):
            leaves = [hashlib.md5(p[i:i + P.PIECE].encode()).hexdigest() for i in range(0, len(p), P.PIECE)]
            digests.append(sha("".join(leaves)))
            short.append("".join(x[:P.SHORT] for x in leaves))
        sections.append(sha("".join(digests)))
        shorts.append("/".join(short))
    return sha("".join(sections)) + ":" + "|".join(shorts)


def like(a, b):
    if a[:64] == b[:64]:
        return 1.0
    pieces = lambda f: {part[i:i + P.SHORT] for part in f[65:].replace("|", "/").split("/") for i in range(0, len(part), P.SHORT)}
    x, y = pieces(a), pieces(b)
    return 2 * len(x & y) / (len(x) + len(y) + 1)


def test_against_plain_python(spark):
    rnd = random.Random(1)
    alphabet = ["word ", "\n", "\n\n", "é😀", "lorem ipsum dolor sit amet ", "\r", " ", "x"]
    rows = [(i * 7 % 101, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))), 1) for i in range(80)]
    rows += [(500, None, 1), (501, "", 1), (502, "same " * 40, 1), (503, "same " * 40, 1), (None, "no id", 1), (504, "long word " * 20_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int").repartition(5)
    for n in (1, 4):
        got = {r.doc_id: r for r in P.fingerprint_edits(df).collect()}
        order = sorted(((-(2 ** 63) if i is None else i, i, t or "") for i, t, _ in rows), reverse=True, key=lambda x: x[0])
        assert len(got) == len(rows)
        for (_, i, t), (_, _, after) in zip(order, order[1:] + order[:1]):
            k = len(t) // 3
            edited = t[:len(t) - k] + after[:k]
            r = got[i]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.fingerprint == tree(t) and r.edited_fingerprint == tree(edited)
            assert abs(r.near_edited - like(tree(t), tree(edited))) < 1e-12 and abs(r.near_next - like(tree(t), tree(after))) < 1e-12
        spark.conf.set("spark.sql.shuffle.partitions", 8 if n == 4 else 4)
    assert got[503].near_next == 1.0


def test_one_row_ties_and_empty(spark):
    one = P.fingerprint_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    same = P.fingerprint_edits(spark.createDataFrame([(5, "abc")] * 4, "doc_id long, text string")).collect()
    assert len(same) == 4 and {r.near_next for r in same} == {1.0}
    assert P.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_locate_edits(spark):
    a = "one\ntwo\n\nthree\nfour\n\nfive"
    df = spark.createDataFrame([(a, a), (a, a.replace("four", "4")), (a, a + "\n\nsix")], "a string, b string")
    got = [r[0] for r in df.select(P.locate_edits(P.fingerprint(F.col("a")), P.fingerprint(F.col("b")))).collect()]
    assert [[tuple(x) for x in g] for g in got] == [[], [(1, 1)], [(3, 0)]]
