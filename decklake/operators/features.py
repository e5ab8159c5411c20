"""Token features: cutting, label masks, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import first_at_least, sums_before
from ..functions.text import let
from .ordering import fresh

#: Fixed value: the label of a token that is not learnt.
IGNORED = -100


def truncated(ids: Column, max_len: int) -> Column:
    return F.slice(ids, 1, max_len)


def label_mask(ids: Column, starts: Column, prompt_len: Column) -> Column:
    """Each id whose token starts at prompt_len or later, IGNORED for the others; starts ascend, so that those are all up to some place."""
    return let(first_at_least(starts, prompt_len), lambda n: F.concat(F.array_repeat(F.lit(IGNORED).cast("long"), n), F.slice(ids, n + 1, F.size(ids) - n)))


def word_features(text: Column) -> tuple[Column, Column]:
    """(ids, starts) of a stand-in tokenizer, which cuts at spaces and takes a word's length for its id. In the row: nothing is exploded."""
    words = F.split(F.coalesce(text, F.lit("")), " ")
    ids = F.transform(words, lambda w: F.length(w).cast("long"))
    return ids, sums_before(F.transform(words, lambda w: F.length(w) + 1))


def padded(df: DataFrame, batch: str, ids: str = "ids", labels: str | None = None, pad: int = 0) -> DataFrame:
    """ids (and labels) filled up on the right to the longest of the batch, with an attention mask of ones and zeros."""
    longest = fresh(df, "longest")[0]
    missing = F.col(longest) - F.size(ids)
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v).cast("long"), missing))
    out = df.withColumn(longest, F.max(F.size(ids)).over(Window.partitionBy(batch)))
    out = out.withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), missing)))
    if labels:
        out = out.withColumn(labels, fill(labels, IGNORED))
    return out.withColumn(ids, fill(ids, pad)).drop(longest)


def with_hook(df: DataFrame, hook) -> DataFrame:
    """df with the columns that a hook adds: DataFrame -> DataFrame, all columns of df kept."""
    out = df.transform(hook)
    missing = [c for c in df.columns if c not in out.columns]
    if missing:
        raise ValueError(f"the hook dropped {missing}")
    return out
