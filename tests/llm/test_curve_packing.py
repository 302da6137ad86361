import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import curve_packing as C

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("dims, bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_unit_steps(dims, bits):
    cells = np.array(np.unravel_index(np.arange(1 << dims * bits), [1 << bits] * dims)).T
    keys = C.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(1 << dims * bits))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_tail_lengths():
    assert all(sum(t) == n and all(x & (x - 1) == 0 for x in t) for n in range(300) for t in [C.tail_lengths(n)])


def check_pieces(rows, texts, got, capacity):
    """Pieces against the plain tokenizer: all tokens once, gapless sequences, no padding."""
    tok = Tokenizer.from_file(PATH)
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    assert set(by) == set(want)
    for d, pieces in by.items():
        ids = want[d][0]
        copies = len(want[d])
        assert all(x == ids for x in want[d])
        assert sum(p.length for p in pieces) == copies * len(ids)
        assert sorted({p.start for p in pieces})[0] == 0
        covered = np.zeros(len(ids), int)
        for p in pieces:
            cut = np.array(ids[p.start:p.start + p.length], "<u4")
            assert zlib.crc32(cut.tobytes()) == p.ids_crc32 and len(cut) == p.length and p.doc_tokens == len(ids)
            assert p.ids is None or bytes(p.ids) == cut.tobytes()
            covered[p.start:p.start + p.length] += 1
        assert (covered == copies).all()
    lengths = []
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        lengths.append(at)
        assert at == capacity or at < capacity and at & (at - 1) == 0
    return lengths


def test_packing_documents_against_the_plain_tokenizer(spark):
    rnd = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta9", "don't", "été", "\n", "x", "zz"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "long text " * 12_000), (None, "no id"), (103, "copy of it"), (103, "copy of it"), (104, "copy of it")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, key string, start int").repartition(5)
    lengths = check_pieces(rows, None, C.pack_on_curve(df, PATH, keep_ids=True).collect(), 4096)
    assert sum(n < 4096 for n in lengths) == bin(sum(lengths) % 4096).count("1")
    assert set(C.pack_on_curve(df, PATH).columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    small = C.pack_on_curve(df.where("doc_id < 60"), PATH, capacity=64, keep_ids=True).collect()
    check_pieces(rows[:60], None, small, 64)
    assert C.pack_on_curve(df.limit(0), PATH).count() == 0
    one = C.pack_on_curve(df.where("doc_id = 101"), PATH).collect()
    assert [(r.length, r.offset, r.doc_tokens) for r in one] == [(1, 0, 1)]


def test_like_documents_are_neighbours(spark):
    """Copies lie side by side, and texts of one vocabulary share sequences far more often than by chance."""
    rnd = random.Random(9)
    vocab = [[f"{a}{b}" for a in "bcdfg" for b in v] for v in ("aeiou", ("ax", "ex", "ix"), ("op", "ul", "an"), ("ing", "est", "ous"))]
    rows = [(i, " ".join(rnd.choices(vocab[i % 4], k=120))) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = C.pack_on_curve(df, PATH, capacity=1024).collect()
    order = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    walk = [d for i, d in enumerate(r.doc_id for r in order) if i == 0 or order[i - 1].doc_id != d]
    copies = [i for i, d in enumerate(walk) if d == 7 or d >= 1000]
    assert copies == list(range(copies[0], copies[0] + 31))
    topics = [7 % 4 if d >= 1000 else d % 4 for d in walk]
    assert sum(a == b for a, b in zip(topics, topics[1:])) / len(topics) > 0.85
