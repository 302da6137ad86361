"""Array expressions that stay linear in the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of a running sum; arrays within a block are grown, so its square is what an element costs at most.
BLOCK = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once.

    What a lambda encloses is evaluated for each of its elements; its own variable is not."""
    return F.get(F.transform(F.array(value), use), 0)


def running_totals(values: Column, levels: int = 3) -> Column:
    """For each element of an array of numbers (bigint) the sum of those before it.

    Sums within blocks, and the same again over the blocks' totals, ``levels`` deep: no array of
    more than ``BLOCK`` elements is grown, except one of the array's length over ``BLOCK`` ** (levels - 1)."""
    zero = F.lit(0).cast("bigint")

    def sums(xs: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    if levels == 1:
        return sums(values)

    def blocked(xs: Column) -> Column:
        count = F.floor((F.size(xs) - 1) / BLOCK)
        blocks = F.transform(F.when(F.size(xs) > 0, F.sequence(F.lit(0).cast("bigint"), count)).otherwise(F.array().cast("array<bigint>")),
                             lambda k: F.slice(xs, (k * BLOCK + 1).cast("int"), BLOCK))
        return bound(blocks, lambda bs: F.flatten(F.zip_with(F.transform(bs, sums), running_totals(F.transform(bs, lambda b: F.aggregate(b, zero, lambda a, x: a + x)), levels - 1),
                                                            lambda inside, before: F.transform(inside, lambda x: x + before))))

    return bound(values, blocked)
