"""Array expressions that stay in their row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Values that are summed one by one; longer arrays are summed block by block.
BLOCK = 128


def sums_before(values: Column) -> Column:
    """Of each place of an array of numbers the sum of the values before it, as longs; nulls count as 0.

    Sums grow in blocks, and then over the blocks' sums, so that no long array is copied for each value: a million values take about BLOCK steps each."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    value = lambda x: F.coalesce(x.cast("long"), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + value(x)).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))

    def prefixes(array: Column) -> Column:
        return F.aggregate(array, F.struct(zero.alias("sum"), none.alias("out")), step)

    def whole(blocks: Column) -> Column:
        starts = prefixes(F.transform(blocks, lambda b: b["sum"]))["out"]
        return let(starts, lambda s: F.flatten(F.transform(blocks, lambda b, k: F.transform(b["out"], lambda x: x + F.get(s, k)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: prefixes(F.slice(values, b * BLOCK + 1, BLOCK)))
    return F.when(F.size(values) > 0, let(blocks, whole)).when(F.size(values) == 0, none)


def first_at_least(sorted_: Column, least: Column) -> Column:
    """The first place (from 0) of an ascending array whose value is `least` or more; the array's size without one. By halving: 31 steps."""

    def step(low: Column, k: Column) -> Column:
        tried = low + F.pow(F.lit(2), k).cast("int")
        return F.when(F.coalesce(F.get(sorted_, tried - 1) < least, F.lit(False)), tried).otherwise(low)

    return F.aggregate(F.sequence(F.lit(30), F.lit(0)), F.lit(0), step)
