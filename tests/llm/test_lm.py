import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import lm


class Plain:
    """Interpolated modified Kneser-Ney with dictionaries."""

    def __init__(self, texts, order):
        self.n, self.counts = order, [None] * (order + 1)
        top, self.raw = Counter(), Counter()
        for t in texts:
            s = ["<s>"] * (order - 1) + self.tokens(t)
            for i in range(order - 1, len(s)):
                top[tuple(s[i - order + 1:i + 1])] += 1
                self.raw[s[i]] += 1
        self.counts[order] = top
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d = [None] + [lm.discounts(*(sum(v == j for v in c.values()) for j in (1, 2, 3, 4))) for c in self.counts[1:]]
        self.after = [None] + [defaultdict(list) for _ in range(order)]
        for k in range(1, order + 1):
            for g, v in self.counts[k].items():
                self.after[k][g[:-1]].append(v)

    @staticmethod
    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["</s>"]

    def p(self, g):
        if not g:
            return 1 / (len(self.raw) + 1)
        lower, seen = self.p(g[1:]), self.after[len(g)].get(g[:-1])
        if not seen:
            return lower
        d, c = self.d[len(g)], self.counts[len(g)].get(g, 0)
        return (max(c - d[min(c, 3)], 0) + sum(d[min(v, 3)] for v in seen) * lower) / sum(seen)

    def score(self, t):
        s = ["<s>"] * (self.n - 1) + self.tokens(t)
        return sum(math.log10(self.p(tuple(s[i - self.n + 1:i + 1]))) for i in range(self.n - 1, len(s)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_plain_model(spark, order):
    rnd = random.Random(order)
    words = ["the", "The", "cat", "sat", "on", "é", "mat", "x y", " ", "dog"]
    text = lambda: rnd.choice([" ", "\n", " \t"]).join(rnd.choice(words[:rnd.randint(2, 10)]) for _ in range(rnd.randint(0, 30)))
    rows = [(i, text(), 0) for i in range(120)] + [(200, None, 0), (201, "", 0), (202, "the " * 3000, 0), (None, "unseen words the", 0), (1, "cat", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(4)
    train = df.where("doc_id < 90 or doc_id >= 200")
    plain = Plain([t for i, t, _ in rows if i is not None and (i < 90 or i >= 200)], order)
    got = lm.score(df, lm.train(train, order=order, buckets=5)).collect()
    want = defaultdict(list)
    for i, t, _ in rows:
        tok = plain.tokens(t)
        n, v = sum(plain.raw.values()), len(plain.raw)
        base = sum(math.log10((plain.raw[w] + 1) / (n + v + 1)) for w in tok)
        want[i].append((len(tok), sum(plain.raw[w] > 0 for w in tok), n, base, plain.score(t)))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    for i in want:
        assert np.allclose(sorted(have[i]), sorted(want[i]), rtol=1e-9), i


def test_probabilities_add_up_to_one():
    plain = Plain(["a b a c", "a a b", "c c c a b"], 2)
    for context in ("a", "b", "c", "never", "<s>"):
        words = [*plain.raw, "unknown"]
        assert sum(plain.p((context, w)) for w in words) == pytest.approx(1)


def test_large_counts_and_empty(spark):
    df = spark.createDataFrame([(1, "a " * 70_000)], "doc_id long, text string")
    r = lm.score(df, lm.train(df, order=2)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (70_001, 70_001, 70_001)
    assert r.score == pytest.approx(Plain(["a " * 70_000], 2).score("a " * 70_000), rel=1e-9)
    empty = lm.train(df.limit(0), order=2)
    assert lm.score(df, empty).first().score == 0 and lm.score(df.limit(0), empty).count() == 0
    with pytest.raises(ValueError):
        lm.mounted("hdfs://x/y")


def test_registered_model_reads_contexts_of_two_words(spark, tmpdir_path):
    from quarry.llm.queries import op1_kneser_ney

    rnd = random.Random(5)
    # the third word follows from the first; the second says nothing
    rows = [(i, " ".join(rnd.choice(["a m x", "b m y"]) for _ in range(6))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmpdir_path}/documents.parquet")
    got = {r.doc_id: r for r in op1_kneser_ney(spark, tmpdir_path).collect()}
    train = [t for i, t in rows if not got[i].held_out]
    assert 0 < len(train) < len(rows)
    three, two = Plain(train, 3), Plain(train, 2)
    for i, t in rows:
        assert got[i].score == pytest.approx(three.score(t), rel=1e-9)
    assert sum(three.score(t) for _, t in rows) > sum(two.score(t) for _, t in rows) + 10
