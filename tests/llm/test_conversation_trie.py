import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quarry.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def key(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def expected(rows):
    """All nodes by plain dictionaries of tuples."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c - (abs(c) % 100) * (1 if c >= 0 else -1))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, totals = defaultdict(int), defaultdict(lambda: [0, 0])
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            totals[n[:d]][0] += children[n] == 0
            totals[n[:d]][1] += (len(m) - 1) * len(n[-1][1]) if n else 0
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], *totals[n],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if rebuilt[c] == n))).encode()).hexdigest()) for n, m in members.items()), key=str)


def got(df, **more):
    return sorted((tuple(r[f] for f in FIELDS) for r in T.conversation_trie(df, **more).collect()), key=str)


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, -7, -100, -130, *range(1000, 1060)]:
        for t in range(rnd.choice([1, 2, 3, 5, 8])):
            hot = c >= 1000 and t < 4
            rows.append((c, t, ["user", "assistant"][t % 2], f"same {t}" if hot else rnd.choice(["yes", "no", "é", "", f"own {c}"])))
    rows += [(300, t, "user", f"long {t}") for t in range(150)] + [(301, t, "user", f"long {t}") for t in range(150)]
    rows += [(302, None, None, None), (302, 3, "user", "x"), (302, 3, "user", "x"), (302, 3, "user", "w"), (None, 0, "user", "nobody")]
    return rows


@pytest.mark.parametrize("block, stretch, parts", [(4096, 4096, 2), (8, 7, 31), (1, 64, 4)])
def test_against_plain_dictionaries(spark, monkeypatch, block, stretch, parts):
    """One task, many rounds with tiny blocks, rounds down to single nodes; long conversations in stretches and over partitions."""
    rows = conversations(block)
    if block == 1:  # a round for each halving down to single nodes: fewer and shorter conversations
        rows = [r for r in rows if (r[0] or 0) < 20 or r[0] in (300, 302, None) and (r[1] or 0) < 40]
    monkeypatch.setattr(T, "STRETCH", stretch)
    monkeypatch.setattr(T, "range_sorted", lambda df, k, t=(), n=0: df.repartitionByRange(parts, *k).sortWithinPartitions(*k, *t))
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA + ", node string, depth int").repartition(3)
    assert got(df, block=block) == expected(rows)


@pytest.mark.parametrize("seed", range(30))
def test_decomposition_of_one_component(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 120)
    reach = rnd.choice([1, 3, n])
    parents = [-1] + [rnd.randint(max(0, i - reach), i - 1) for i in range(1, n)]
    values = [(rnd.randint(0, 9), rnd.randint(-5, 5)) for _ in range(n)]
    want = [list(v) for v in values]
    for i in range(n - 1, 0, -1):
        want[parents[i]] = [a + b for a, b in zip(want[parents[i]], want[i])]
    assert T.decompose(parents, values) == want


def test_empty_tables_and_long_texts(spark):
    assert T.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b"), (500, 0, "user", "long " * 300_000), (600, 0, "user", "long " * 300_000)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 6 == 0 or r[0] == c or r[0] % 100 == 0]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == expected(rows)  # conversation c is left without turns
    assert (c, 0) in {(r[0], r[1]) for r in got(df)}
