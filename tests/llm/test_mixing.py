from collections import Counter
from fractions import Fraction

import pytest

from quarry.llm import mixing as M


@pytest.mark.parametrize("parts", [[1], [1, 1], [7, 3, 2, 1], [8, 5, 4, 3, 20], [1, 99], [13, 13, 13, 1, 60]])
def test_period_deviates_by_less_than_one_block(spark, parts):
    rows = sorted(M.period(spark, parts).collect(), key=lambda r: r.slot)
    total, had = sum(parts), Counter()
    assert [r.slot for r in rows] == list(range(total))
    for r in rows:
        assert list(r.before) == [had[i] for i in range(len(parts))] and r.k == had[r.stream]
        had[r.stream] += 1
        for i, c in enumerate(parts):
            assert abs(had[i] - Fraction(c * (r.slot + 1), total)) < 1
    assert [had[i] for i in range(len(parts))] == parts


def test_mix_places_each_row_once(spark):
    rows = [(i, "a" if i % 3 else "b", "x") for i in range(400)] + [(900 + i, f"s{i % 7}", "x") for i in range(60)] + [(7, None, "x"), (None, "a", "x"), (7, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    got = M.mix(df, {"a": 2, "b": 3, "absent": 1}, 2, block_docs=4).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, s, _ in rows)
    by = sorted(got, key=lambda r: r.position)
    assert [r.slot for r in by] == sorted(r.slot for r in by)
    assert all(r.release <= r.slot < r.deadline for r in got)
    # each source found has a stream of its own: a, b, absent, then null, s0, ...
    assert {r.source: r.stream for r in got} == {"a": 0, "b": 1, None: 3, **{f"s{i}": 4 + i for i in range(7)}}


def test_mix_edges(spark):
    df = spark.createDataFrame([], "doc_id long, source string")
    assert M.mix(df, {"a": 1}, 1).count() == 0
    with pytest.raises(ValueError):
        M.period(spark, [0, 1])
    one = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    assert M.mix(one, {}, 1).first().position == 0
    nine = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(9)], "doc_id long, source string")
    assert [r.position for r in M.in_order(M.mix(nine, {"a": 1}, 2, block_docs=1)).collect()] == list(range(9))


def test_unnamed_sources_have_bounds_of_their_own(spark):
    """A hot unnamed source does not crowd out a small one: all deviate by less than one block while none has run out."""
    rows = [(i, "src0") for i in range(4000)] + [(5000 + i, "hot") for i in range(5000)] + [(20_000 + i, "cold") for i in range(160)]
    got = sorted(M.mix(spark.createDataFrame(rows, "doc_id long, source string"), {"src0": 1}, 1, block_docs=1).collect(), key=lambda r: r.slot)
    share, had = {"src0": Fraction(1, 2), "hot": Fraction(1, 4), "cold": Fraction(1, 4)}, Counter()
    assert [r.slot for r in got if r.in_share] == list(range(160 * 4))
    for r in got[:640]:
        had[r.source] += 1
        assert all(abs(had[s] - w * (r.slot + 1)) < 1 for s, w in share.items())
    assert had["cold"] == 160 and not any(r.in_share for r in got[640:])


def test_a_null_and_an_empty_source_differ(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, source string")
    assert {r.source: r.stream for r in M.mix(df, {}, 1).collect()} == {None: 0, "": 1, "a": 2}
    with pytest.raises(ValueError):
        M.streams_of(spark.range(20).selectExpr("id AS doc_id", "CAST(id AS string) AS source"), {"0": 1}, M.MAX_PARTS)
