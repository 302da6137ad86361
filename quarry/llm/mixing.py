"""Mixing sources to target weights by Pfair scheduling.

Weights are whole parts of a period.  Block k of a source with c of P parts is
released at floor(k P / c) and due at ceil((k + 1) P / c); earliest deadline
first over the released blocks meets every deadline, as the parts fill the period
exactly.  So after any number of slots each source has had its share to within
less than one block.  At a period's end all shares are exact and the schedule
repeats: only one period (``MAX_PARTS`` slots at most) is scheduled, and block k's
slot follows by division.  Every source is a stream: named ones with their weights, the others
with even parts of the rest.  A source that has run out leaves its slots empty; the
rest go on in proportion to their weights.  Every document is placed once.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_DOCS, MAX_PARTS = 16, 10_000
#: First digits of the hash that make a bucket, more where a source would have more rows than this in each.
HASH_DIGITS, BUCKET_ROWS = 3, 20_000


def period(spark: SparkSession, parts: list[int]) -> DataFrame:
    """The earliest-deadline-first schedule of one period: slot, stream, k (the stream's block), before (blocks of each stream before the slot)."""
    total = sum(parts)
    if total > MAX_PARTS or min(parts) < 1:
        raise ValueError(f"weights are whole parts of at least 1, and {MAX_PARTS} in all")
    c = F.array(*map(F.lit, parts))
    start = F.struct(F.array_repeat(F.lit(0), len(parts)).alias("k"), F.array().cast("array<struct<stream:int,k:int,before:array<int>>>").alias("out"))

    def step(s, t):
        # due and stream of the next block of each stream; those not released yet come last
        next_blocks = F.transform(s["k"], lambda k, i: F.struct(
            F.when((k < F.get(c, i)) & (k * total < (t + 1) * F.get(c, i)), F.ceil((k + 1) * total / F.get(c, i)).cast("int")).otherwise(2 * total + 1).alias("due"), i.alias("i")))
        pick = F.array_min(next_blocks)["i"]
        return F.struct(F.transform(s["k"], lambda k, i: k + (i == pick).cast("int")).alias("k"),
                        F.concat(s["out"], F.array(F.struct(pick.alias("stream"), F.get(s["k"], pick).alias("k"), s["k"].alias("before")))).alias("out"))

    slots = F.aggregate(F.sequence(F.lit(0), F.lit(total - 1)), start, step, lambda s: s["out"])
    return spark.range(1).select(F.posexplode(slots).alias("slot", "s")).select("slot", "s.stream", "s.k", "s.before")


def streams_of(docs: DataFrame, weights: Mapping[str, int], rest: int, source_col: str = "source") -> tuple[list[str | None], list[int]]:
    """A stream for each named source and for each other one found in ``docs`` (null is one), and their whole parts.

    The others share ``rest`` evenly: all weights are taken as many times as there are others, each of which
    has ``rest`` parts then, and divided by what they have in common.  Sources are found by an aggregate; there may be as
    many as parts, ``MAX_PARTS``."""
    named = list(weights)
    kinds = docs.select(F.col(source_col).cast("string").alias("s")).distinct()
    found = [r["s"] for r in kinds.limit(MAX_PARTS + 1).collect()]
    others = sorted((s for s in found if s not in weights), key=lambda s: (s is not None, s or ""))
    parts = [w * max(1, len(others)) for w in weights.values()] + [rest] * len(others)
    if not parts:
        return [], []
    common = gcd(*parts)
    if min(parts) < 1 or sum(parts) // common > MAX_PARTS:
        raise ValueError(f"weights are whole parts of at least 1, and {MAX_PARTS} in all with every source found")
    return named + others, [p // common for p in parts]


def mix(docs: DataFrame, weights: Mapping[str, int], rest: int, id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS,
        ties: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with stream, block, release, deadline, slot, position (0, 1, ... over all rows) and in_share.

    ``weights``: parts by source name; ``rest``: parts of all other sources
    together (a null source is one), shared evenly among those found (:func:`streams_of`): each is a stream
    with release times and deadlines of its own.  Within a stream rows go
    by the MD5 of their id, then by a hash of the columns ``ties``; what is equal ties in any order; a null id counts as an
    empty one.  Rows are numbered within hash buckets and offset by the buckets'
    counts, so a source with most rows is spread over many tasks; buckets grow in number with the rows.  Target
    weights hold as long as every source has blocks left: ``in_share`` is true for slots before the
    first release time of a block that is missing.  Other columns
    are passed on; columns with the new names are replaced.
    """
    spark = docs.sparkSession
    new = ["stream", "block", "release", "deadline", "slot", "position", "in_share"]
    docs = docs.drop(*({*new, "__h", "__b", "__n", "__k", "__s", "__j", "__slot", "before"} & set(docs.columns)))
    names, parts = streams_of(docs, weights, rest, source_col)
    if not names:
        return docs.limit(0).withColumns({"stream": F.lit(0), **{c: F.lit(0).cast("long") for c in new[1:-1]}, "in_share": F.lit(True)})
    total = sum(parts)
    known = F.array_position(F.array(*(F.lit("" if s is None else s) for s in names)), F.col(source_col).cast("string")) - 1
    stream = F.when(F.col(source_col).isNull(), F.lit(names.index(None) if None in names else 0)).otherwise(known).cast("int")
    if None in names:  # an empty name is not the null source
        empty = names.index("") if "" in names else None
        stream = F.when(F.col(source_col).isNull(), F.lit(names.index(None))).when(F.col(source_col).cast("string") == "", F.lit(empty)).otherwise(known).cast("int")
    sized = docs.withColumn("stream", stream).withColumn("__h", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    totals = {r["stream"]: r["n"] for r in sized.groupBy("stream").agg(F.count("*").alias("n")).collect()}  # a row per stream
    digits = HASH_DIGITS
    while 16 ** digits * BUCKET_ROWS < max(totals.values(), default=0):
        digits += 1
    rows = sized.withColumn("__b", F.left("__h", F.lit(digits)))
    counts = rows.groupBy("stream", "__b").agg(F.count("*").alias("n"))
    offsets = counts.select("stream", "__b", (F.sum("n").over(Window.partitionBy("stream").orderBy("__b")) - F.col("n")).alias("__n"))
    n = F.col("__n") + F.row_number().over(Window.partitionBy("stream", "__b").orderBy("__h", id_col, *([F.xxhash64(*ties)] if ties else []))) - 1
    rows = rows.join(offsets, ["stream", "__b"]).withColumn("__n", n)

    c = F.get(F.array(*map(F.lit, parts)), F.col("stream"))
    rows = rows.withColumn("block", F.floor(F.col("__n") / block_docs)).withColumn("__k", (F.col("block") % c).cast("int"))
    plan = F.broadcast(period(spark, parts).select(F.col("stream").alias("__s"), F.col("k").alias("__j"), F.col("slot").alias("__slot"), "before"))  # MAX_PARTS rows at most
    rows = rows.join(plan, (F.col("stream") == F.col("__s")) & (F.col("__k") == F.col("__j")))
    cycle = F.floor(F.col("block") / c)
    # documents of every stream before this slot
    of_stream = F.array(*(F.struct(F.lit(p).cast("long").alias("p"), F.lit(totals.get(i, 0)).cast("long").alias("n")) for i, p in enumerate(parts)))
    had = F.zip_with("before", of_stream, lambda k, x: F.least(x["n"], (cycle * x["p"] + k) * block_docs))
    position = F.aggregate(had, F.lit(0).cast("long"), lambda a, x: a + x) + F.col("__n") % block_docs
    share = min(-(-totals.get(i, 0) // block_docs) * total // p for i, p in enumerate(parts))
    slot = (cycle * total + F.col("__slot")).cast("long")
    return rows.select(*docs.columns, "stream", F.col("block").cast("long"), F.floor(F.col("block") * total / c).cast("long").alias("release"),
                       F.ceil((F.col("block") + 1) * total / c).cast("long").alias("deadline"), slot.alias("slot"), position.cast("long").alias("position"), (slot < share).alias("in_share"))


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows of :func:`mix` written so: range partitions by position, sorted, each file a stretch of the mixture."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position")
