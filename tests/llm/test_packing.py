import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from quarry.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_tokenizer_equals_the_whole_tokenizer():
    tok, rnd = P.WordTokenizer(PATH), random.Random(3)
    parts = ["the", "The", "don't", "it's", "'S", "''s", "x1y22", "%%%", "a,", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x00", "é", "É", "é",
             "İ", "ß", "Σ", "ς", " ", " ", "　", "漢字", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "ﬁ", "½", "́", "\x7f", "zzzqqq", "Ω", "Été", "×", "÷", "naïve", "ÿ", "µ", "ª", "¿que", "ÀÖ"]
    for _ in range(1500):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20)))
        want = np.array(tok.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert tok.ids(t) == want, repr(t)


def placed(rows, histogram, capacity):
    bins, ranks = defaultdict(list), defaultdict(list)
    for n, rank, count, each, seq, off in rows:
        for r in range(count * each):
            bins[seq + r // each].append((off + r % each * n, n))
            ranks[n].append(rank + r)
    for n, c in histogram.items():
        assert sorted(ranks[n]) == list(range(c))
    for content in bins.values():
        at = 0
        for off, n in sorted(content):
            assert off == at
            at += n
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_each_piece_once_and_nearly_fills(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([64, 512, 4096])
    kind = rnd.choice(["uniform", "small", "large", "one"])
    draw = {"uniform": lambda: rnd.randint(1, cap), "small": lambda: rnd.randint(1, max(1, cap // 9)), "large": lambda: rnd.randint(cap // 3, cap), "one": lambda: cap // 2 + 1}[kind]
    h = dict(Counter(draw() for _ in range(rnd.choice([1, 7, 3000]))))
    rows, n = P.plan_bins(h, cap)
    assert placed(rows, h, cap) == n
    # first fit decreasing on the items themselves
    free = []
    for x in sorted((x for x, c in h.items() for _ in range(c)), reverse=True):
        i = next((i for i, f in enumerate(free) if f >= x), None)
        if i is None:
            free.append(cap - x)
        else:
            free[i] -= x
    assert n <= len(free) * 1.05 + 2


def test_packing_documents(spark):
    long = "word " * 9000
    rows = [(1, "Hello world", "a"), (2, None, "b"), (3, "", "c"), (4, long, "d"), (5, "Hello world", "e"), (5, "Hello world", "e"), (None, "x", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    out = P.pack_documents(df, PATH, keep_ids=True).cache()
    got = out.collect()
    tok = P.WordTokenizer(PATH).tok
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for doc_id, text, _ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        want = [ids[k:k + 4096] for k in range(0, len(ids), 4096)]
        have = sorted(by[doc_id], key=lambda r: r.piece)
        have = have[:: 2] if doc_id == 5 else have
        assert [np.frombuffer(r.ids, "<u4").tolist() for r in have] == want
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids) and r.start == r.piece * 4096 for r in have)
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert len(seq) == 3
    assert {r.sequence_id: len(r.ids) // 4 for r in P.sequences(out).collect()} == {k: sum(n for _, n in v) for k, v in seq.items()}
    assert P.pack_documents(df.limit(0), PATH).count() == 0
