"""Sampling, mixing and resuming. All orders are total: rows need a unique `seq`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chat
from ..functions import text as T
from . import ordering


def head(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first n rows in order of seq (a top-k, no full sort)."""
    return df.orderBy(seq).limit(n)


def physical_head(df: DataFrame, n: int, line_no: str = "line_no") -> DataFrame:
    """Rows of the first n physical lines, which may hold fewer records."""
    return df.where(F.col(line_no) < n)


def stratified(df: DataFrame, is_tail: str, n_head: int, limit: int | None = None, seq: str = "seq") -> DataFrame:
    """All tail rows, then the first n_head others in order of seq; then at most limit rows. Only a top-k is ordered."""
    tail, others = df.where(F.col(is_tail)), head(df.where(~F.col(is_tail)), n_head, seq)
    out = tail.unionByName(others)
    ordered = out.orderBy(F.desc(is_tail), seq)
    return ordered.limit(limit) if limit is not None else ordered


def shuffled(df: DataFrame, seed: int, seq: str = "seq") -> DataFrame:
    """A permutation that the seed decides: order by hash, ties by seq."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(seq)), seq)


def mixed(first: DataFrame, second: DataFrame, column: str, subset: int | None = None, seq: str = "seq") -> DataFrame:
    """One column of two datasets; a subset is taken of the first only, before they are put together."""
    a = head(first, subset, seq) if subset is not None else first
    return a.select(F.lit(0).alias("dataset"), seq, column).unionByName(second.select(F.lit(1).alias("dataset"), seq, column))


def resumed(df: DataFrame, done: DataFrame, key: str = "seq") -> DataFrame:
    """Rows whose key is not done yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def resumed_at(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Rows after the first k, by their ordinal."""
    return df.where(F.col(seq) >= k)


def zipped(first: DataFrame, *others: DataFrame, ordinal: str = "seq") -> DataFrame:
    """Rows put side by side by ordinal, as far as all go."""
    for other in others:
        first = first.join(other, ordinal)
    return first


def running(df: DataFrame, value: str, seq: list[str], by: list[str] | None = None) -> DataFrame:
    """Running count, sum and rate of a value: of each group in a window; over one long log by ranges of its order."""
    if not by:
        out = ordering.running(df, seq, {"so_far": value})
        return out.withColumn("rate", F.col("so_far") / F.col("idx"))
    w = Window.partitionBy(*by).orderBy(*seq).rowsBetween(Window.unboundedPreceding, 0)
    n, s = F.count(F.lit(1)).over(w), F.sum(value).over(w)
    return df.withColumns({"idx": n, "so_far": s, "rate": s / n})


def remaining(df: DataFrame, seconds: str, seq: list[str], every: int = 25) -> DataFrame:
    """Each `every`-th row of one long log with the mean time so far and the time that is left: the mean for each row to come."""
    out = running(df, seconds, seq)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    left = F.col("rate") * (F.col("total") - F.col("idx"))
    return out.where(F.col("idx") % every == 0).crossJoin(F.broadcast(total)).withColumn("eta", left).drop("total")  # a single row


def spoken(chats: DataFrame, role: str, key: str = "conv_id", messages: str = "messages") -> DataFrame:
    """(key, text): a row for each turn of a role, without its scratchpad; turns that are empty then go."""
    turns = chats.select(key, F.explode(chat.of_role(messages, role)).alias("m"))
    return turns.select(key, T.without_scratchpad("m.content").alias("text")).where("text != ''")
