import random
import re

import numpy as np
import pytest

from quarry.llm import jaccard as J
from quarry.llm.lm import WordHashes


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t, *_ in rows]
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and den * len(a & b) >= num * len(a | b):
                group[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), low[find(i)] if r[0] is not None else None) for i, r in enumerate(rows)), key=repr)


def corpus(seed, n=160):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "the", "The"]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts = []
    while len(texts) < n:
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 5, 12, 40, 100, 300]))]
        if rnd.random() < 0.3:
            words += passage
        texts.append(words)
        for _ in range(rnd.choice([0, 0, 1, 4, 9])):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                at = rnd.randrange(len(copy))
                copy[at:at + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [copy[at], "x"]])
            texts.append(copy or ["x"])
    ids = rnd.sample(range(10 * len(texts)), len(texts))
    return [(i, rnd.choice([" ", "\n", "  \t"]).join(t), 1) for i, t in zip(ids, texts)]


@pytest.mark.parametrize("short", [1, 3])
def test_long_lists_lose_nothing(spark, monkeypatch, short):
    monkeypatch.setattr(J, "SHORT", short)
    rows = corpus(11 + short)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles long").repartition(6)
    assert sorted(map(tuple, J.jaccard_components(df, 3, 80, 100).collect()), key=repr) == brute(rows, 3, 80, 100)


@pytest.mark.parametrize("seed,k,num,block", [(1, 3, 90, 10 ** 6), (2, 5, 80, 10 ** 6), (3, 3, 80, 400), (4, 2, 60, 3000)])
def test_against_brute_force(spark, seed, k, num, block):
    rows = corpus(seed) + [(99991, None, 1), (99992, "", 1), (99993, " \n", 1), (None, "w1 w2 w3 w4", 1), (99994, "w1 w2 w3 w4", 1), (99995, "W1 w2\tw3 w4", 1),
                           (99996, "long text of words " * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles long").repartition(6)
    got = sorted(map(tuple, J.jaccard_components(df, k, num, 100, block_shingles=block).collect()), key=repr)
    assert got == brute(rows, k, num, 100)


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(none).count() == 0
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (8, "e f g")], "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df).collect())) == [(3, 2, 3), (5, 2, 3), (5, 2, 3), (8, 1, 8)]


@pytest.mark.parametrize("heap", [0, 500])
def test_divide_skip_finds_all_with_t_occurrences(monkeypatch, heap):
    monkeypatch.setattr(J, "HEAP_ENTRIES", heap)
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    lists = J.InvertedLists(sets)
    for s in sets[:40]:
        for t in (2, len(s) // 2 + 1, len(s)):
            if t >= 2:
                assert set(lists.query(s, t).tolist()) == {j for j, x in enumerate(sets) if len(np.intersect1d(s, x)) >= t}


@pytest.mark.parametrize("num", [90, 80])
def test_every_pair_at_the_threshold_shares_a_key(num):
    rnd, bands = np.random.default_rng(num), J.Bands(num, 100)
    for _ in range(1500):
        n = int(rnd.choice([1, 3, 8, 15, 40, 150, 700]))
        base = np.unique(rnd.integers(0, 2 ** 63, n).astype(np.uint64) * np.uint64(2))
        other = base.copy()
        cut = rnd.integers(0, max(1, int(n * (100 - num) / 100)) + 1)
        add = rnd.integers(0, max(1, int(n * (100 - num) / 100)) + 1)
        other = np.unique(np.concatenate([rnd.permutation(other)[cut:], rnd.integers(0, 2 ** 63, add).astype(np.uint64)]))
        if len(other) and J.similar(base, other, num, 100):
            a, b = bands.keys(base), bands.keys(other)
            # in the larger one's band both take part, and share what each of them needs there
            band = max(a[0][0], b[0][0])
            (need_a, keys_a), (need_b, keys_b) = (next((n, set(k.tolist())) for at, n, k in x if at == band) for x in (a, b))
            assert len(keys_a & keys_b) >= max(need_a, need_b) >= 1


def test_words_fold_and_split_like_the_contract():
    h = WordHashes()
    assert J.shingle_set("A b\x0bC", 3, h).tolist() == J.shingle_set("a B c", 3, h).tolist()
    assert J.shingle_set("É b c", 3, h).tolist() != J.shingle_set("é b c", 3, h).tolist()
    assert len(J.shingle_set("a\xa0b c", 3, h)) == 1 and len(J.shingle_set("a b", 3, h)) == 1
