"""Places and running sums over one total order, without a task that sees all rows.

Rows are dealt into ranges of the order and sorted there; a range numbers and sums its own rows while it is written, and gets what comes
before it from the sums of the ranges before, of which there are as many as shuffle partitions. The ranges are written once and read
twice, so that both reads see the same bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import written


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def running(df: DataFrame, order: list[str | Column], sums: dict[str, str] | None = None, place: str = "idx") -> DataFrame:
    """df with the place of each row in the order (from 1), and running sums {new column: column of numbers} up to and with the row.

    Sums of whole numbers are whole and exact, others are doubles; nulls add nothing. The order should be total: rows that tie come in any order
    among themselves. New columns replace those of the same name."""
    sums = sums or {}
    whole = {new: isinstance(df.schema[old].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for new, old in sums.items()}
    kept = df.drop(place, *[new for new in sums if new not in sums.values()])
    at, *news = fresh(kept, "at", *[f"sum_{k}" for k in range(len(sums))])
    range_, place_ = fresh(kept, "range", "place")
    add = dict(zip(news, sums.items(), strict=True))
    schema = T.StructType([*kept.schema.fields, T.StructField(range_, T.IntegerType()), T.StructField(place_, T.LongType())])
    for name, (new, _) in add.items():
        schema = schema.add(name, T.LongType() if whole[new] else T.DoubleType())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, totals = TaskContext.get().partitionId(), 0, dict.fromkeys(add, 0)
        for batch in batches:
            cols, names, k = list(batch.columns), list(batch.schema.names), batch.num_rows
            cols += [pa.array(np.full(k, part, np.int32)), pa.array(np.arange(n + 1, n + k + 1))]
            for name, (new, old) in add.items():
                kind = pa.int64() if whole[new] else pa.float64()
                so_far = pc.cumulative_sum_checked(pc.fill_null(batch.column(old).cast(kind), pa.scalar(0, kind)), start=pa.scalar(totals[name], kind))
                totals[name] = so_far[-1].as_py() if k else totals[name]
                cols.append(so_far)
            n += k
            yield pa.RecordBatch.from_arrays(cols, names=[*names, range_, place_, *add])

    rows = written(kept.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema))
    ends = rows.groupBy(F.col(range_).alias(at)).agg(F.max(place_).alias(place_), *[F.max_by(name, place_).alias(name) for name in add])
    # a row for each range
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    shift = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    shifts = ends.select(at, shift(place_).alias(f"{at}_n"), *[shift(name).alias(f"{at}_{name}") for name in add])
    met = rows.join(F.broadcast(shifts), F.col(range_) == F.col(at))
    out = [F.col(f"`{c}`") for c in kept.columns if c not in sums]
    out.append((F.col(place_) + F.col(f"{at}_n")).alias(place))
    return met.select(*out, *[(F.col(name) + F.col(f"{at}_{name}")).alias(new) for name, (new, _) in add.items()])


def ranked(df: DataFrame, by: str, order: list[str | Column], rank: str) -> DataFrame:
    """df with the place of each row in its group, from 1, in the order: its place among all rows, less that of the group's first."""
    all_, first, group = fresh(df, "place", "first", "group")
    rows = running(df, [by, *order], place=all_)
    firsts = rows.groupBy(F.col(by).alias(group)).agg(F.min(all_).alias(first))
    met = rows.join(firsts, F.col(by).eqNullSafe(F.col(group)))
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c != rank], (F.col(all_) - F.col(first) + 1).alias(rank))
