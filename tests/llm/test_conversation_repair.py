import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from quarry.llm import conversation_repair as R

NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def legal(before, initial):
    return initial in {"": "su", "s": "u", "u": "a", "a": "u"}[before] if initial else False


def cheapest(turns):
    """(cost, audit, roles and texts) by trying every edit; turns: (role, text, must go, truncated)."""
    @cache
    def best(i, before):
        found = []
        if i == len(turns) and before in ("", "a"):
            found.append((0, "", ()))
        if i < len(turns):
            role, text, gone, cut = turns[i]
            c, a, t = best(i + 1, before)
            found.append((3 + c, "D" + a, t))
            if not gone:
                if legal(before, role[:1]):
                    c, a, t = best(i + 1, role[:1])
                    found.append((cut + c, "K" + a, ((role, text),) + t))
                c, a, t = best(i + 1, NEXT[before][0])
                found.append((2 + cut + c, "R" + a, ((NEXT[before], text),) + t))
        # one inserted turn, then no other than by need: two would bring the same state back
        return min(found + inserted(i, before), key=lambda x: x[:2]) if found or inserted(i, before) else (10**9, "", ())

    def inserted(i, before, depth=0):
        out, cost, said, at = [], 0, (), before
        for k in range(2):
            said += ((NEXT[at], ""),)
            at, cost = NEXT[at][0], cost + 2
            for c, a, t in direct(i, at):
                out.append((cost + c, "I" * (k + 1) + a, said + t))
        return out

    def direct(i, before):
        out = []
        if i == len(turns):
            return [(0, "", ())] if before in ("", "a") else []
        role, text, gone, cut = turns[i]
        c, a, t = best(i + 1, before)
        out.append((3 + c, "D" + a, t))
        if not gone:
            if legal(before, role[:1]):
                c, a, t = best(i + 1, role[:1])
                out.append((cut + c, "K" + a, ((role, text),) + t))
            c, a, t = best(i + 1, NEXT[before][0])
            out.append((2 + cut + c, "R" + a, ((NEXT[before], text),) + t))
        return out

    return best(0, "")


SPACE = " \t\n\x0b\x0c\r"


def expected(rows):
    """Reports of whole conversations by the plain way; rows of damaged turns by conversation, in order."""
    out = {}
    for conv, turns in rows.items():
        counts, seen, marked = defaultdict(int), set(), []
        for turn, role, text in turns:
            last = text.rstrip(SPACE)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = {t for t, _, _ in turns if t is not None}
        cost, audit, done = cheapest(tuple(marked))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in done))
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, counts["blank"], counts["duplicate"], counts["truncated"],
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def plant(rows):
    """The query's damage, in plain Python; rows: (conv, turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        said = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(said.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv]
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)

    def order(t):
        key = hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()
        return t[0] is not None, t[0] or 0, key

    return {c: sorted(t, key=order) for c, t in out.items()}


def conversations(seed, n):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rnd.randint(0, 12)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["a.", "b!", "c", "d?  ", "  ", None, "e. f", "A.", "é。", f"x{t}."])
            rows.append((c, rnd.choice([t, t, t, t + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("seed", range(60))
def test_tables_give_the_cheapest_and_least_edits(seed):
    rnd = random.Random(seed)
    t = R.tables()
    turns = [(rnd.choice(["user", "assistant", "system", "tool"]), f"t{i}", rnd.random() < 0.15, rnd.random() < 0.2) for i in range(rnd.randint(0, 14))]
    turns = [(r, x, g, c and not g) for r, x, g, c in turns]
    symbols = bytes(R.GONE if g else 2 * "suat".find(r[0]) + c for r, _, g, c in turns)
    cost, edits = t.trace(symbols)
    want = cheapest(tuple(turns))
    assert (cost, "".join(edits)) == want[:2] and R.paid(symbols, edits) == cost
    roles, texts = R.apply_edits(edits, [x[0] for x in turns], [x[1] for x in turns])
    assert tuple(zip(roles, texts)) == want[2]
    # in two stretches, through their summaries
    cut = rnd.randint(0, len(symbols))
    (v1, s1), (v2, s2) = t.summary(symbols[:cut]), t.summary(symbols[cut:])
    middle = int(s1[v2[0], 0])
    first, second = t.trace(symbols[:cut], int(v2[0]), 0, False)[1], t.trace(symbols[cut:], 0, middle)[1]
    assert "".join(first + second) == want[1]


@pytest.mark.parametrize("stretch, parts", [(4096, 1), (3, 1), (3, 7), (4096, 40)])
def test_reports_against_brute_force(spark, monkeypatch, stretch, parts):
    """Also with conversations in short stretches and over many partitions."""
    rows = conversations(3, 40) + [(None, 0, "user", "who?"), (None, 1, "assistant", "I."), (500, None, "user", "x."), (500, None, "user", "x."), (600, 7, None, None)]
    rows += [(700, t, "user" if t % 2 == 0 else "assistant", f"turn {t}{'.' if t % 5 else ''}") for t in range(60)]
    monkeypatch.setattr(R, "STRETCH", stretch)
    monkeypatch.setattr(R, "range_sorted", lambda df, k, t=(), n=0: df.repartitionByRange(parts, *k).sortWithinPartitions(*k, *t))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(3)
    got = R.report(R.repair(R.damage(df))).collect()
    want = expected(plant(rows))
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in got} == want


def test_empty_table_and_dropped_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert R.report(R.repair(R.damage(spark.createDataFrame([], schema)))).count() == 0
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = R.report(R.repair(R.damage(spark.createDataFrame([(c, 0, "user", "gone.")], schema)))).first()
    assert tuple(got) == (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    long = "word " * 400_000
    got = R.report(R.repair(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "ok.")], schema))).first()
    assert (got.truncated, got.cost, got.audit) == (1, 1, "KK")
    assert got.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:ok.".encode()).hexdigest()
