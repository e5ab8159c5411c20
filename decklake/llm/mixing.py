"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length; per source a bounded-knapsack dynamic program fills the remaining budget
to the word; then, per (source, length), as many documents as the fit asks for are selected in seeded hash order.

Bounds: the driver gets one row per source (at most MAX_SOURCES, checked). The dynamic program runs on the executors,
one task per source, over that source's distinct lengths (not its rows). Selection ranks rows within (source, length,
bucket) only, BUCKETS hash buckets to a length, so a source or a length with a third of all rows is spread out.

Edge cases: null texts have length 0: they take no words, however often they are taken; a null source is a source of its
own, the last; repeated rows count and are ranked as rows; ties in hash order are broken by id; an empty table gives an
empty result. Texts of any length are counted in their row. mix() reads three columns only, repeated() hands on all, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of, words_of

#: The weights repeat over the sources in order; the mix has this share of all words; no document more than this often.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_PASSES = 2
SEED = 17
MAX_SOURCES = 100_000
BUCKETS = 1024
#: Words that greedy filling leaves to the dynamic program.
SLACK = 4096


def targets(sizes: list[int], weights: list[float], budget: float) -> list[float]:
    """Shares of the budget by weight, none above MOST_PASSES times its size; what is cut off is shared among the others by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), budget
    while free:
        total = sum(weights[i] for i in free)
        above = [i for i in sorted(free) if left * weights[i] / total >= MOST_PASSES * sizes[i]]
        if not above:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = float(MOST_PASSES * sizes[i])
        left -= sum(out[i] for i in above)
        free -= set(above)
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take for a sum as near below the budget as can be.

    An even share of each length first, long ones next while much is left, and the exact rest by bounded knapsack:
    counts are split into powers of two, and each reachable sum remembers the piece that first reached it."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return take
    take = (counts * (budget / total)).astype(np.int64)
    left = budget - int((lengths * take).sum())
    order = np.argsort(-lengths)
    for i in order:
        if lengths[i] and left > SLACK + lengths[i]:
            n = min(int(counts[i] - take[i]), int((left - SLACK) // lengths[i]))
            take[i] += n
            left -= n * int(lengths[i])
    reach, by = np.zeros(left + 1, bool), np.full(left + 1, -1)
    reach[0], pieces = True, []
    for i in order[::-1]:
        n = min(int(counts[i] - take[i]), left // int(lengths[i])) if 0 < lengths[i] <= left else 0
        size = 1
        while n > 0 and not reach[left]:
            m = min(size, n)
            w = m * int(lengths[i])
            new = np.flatnonzero(reach[: left + 1 - w] & ~reach[w:]) + w
            by[new], reach[new] = len(pieces), True
            pieces.append((i, m))
            n, size = n - m, size * 2
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, m = pieces[by[at]]
        take[i] += m
        at -= m * int(lengths[i])
    return take


def _keyed(docs: DataFrame, seed: int, id: str, source: str, text: str) -> dict[str, Column]:
    """What a row is counted and ranked by: source key, size, hash, bucket."""
    key = F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source)))
    hashed = F.xxhash64(F.lit(seed), F.col(id), F.col(text))
    return {"key": key, "size": F.size(words_of(text_of(text))).cast("long"), "h": hashed, "bucket": F.pmod(hashed, F.lit(BUCKETS)).cast("int")}


def _quotas(rows: DataFrame, weights: tuple[float, ...], share: float) -> tuple[DataFrame, DataFrame]:
    """From rows (key, size, bucket): (key, size, bucket, prior, quota) and (key, source_size, target, whole)."""
    spark = rows.sparkSession
    counted = rows.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sums = counted.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    found = sums.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.key == "0", r.key))
    size = [r.words for r in found]
    aims = targets(size, [weights[i % len(weights)] for i in range(len(found))], share * sum(size))
    table = [(r.key, s, t, min(MOST_PASSES, int(t // s)) if s else 0) for r, s, t in zip(found, size, aims, strict=True)]
    aim = spark.createDataFrame(table, "key string, source_size long, target double, whole int")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        left = round(pdf.target[0] - pdf.whole[0] * pdf.source_size[0])
        return pd.DataFrame({"key": pdf.key, "size": pdf["size"], "quota": fit(pdf["size"].to_numpy(), pdf.n.to_numpy(), left)})

    lengths = counted.groupBy("key", "size").agg(F.sum("n").alias("n")).join(F.broadcast(aim), "key")
    quota = lengths.groupBy("key").applyInPandas(fitted, "key string, size long, quota long")
    before = F.sum("n").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    prior = counted.withColumn("prior", F.coalesce(before, F.lit(0))).join(quota, ["key", "size"]).select("key", "size", "bucket", "prior", "quota")
    return prior, aim


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(id, source, size, source_size, target, passes, taken) of each row; passes is how often the mix takes the row."""
    keyed = _keyed(docs, seed, id, source, text)
    rows = stored(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), *[c.alias(n) for n, c in keyed.items()]))
    prior, aim = _quotas(rows, weights, share)
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", "id"))
    passes = F.col("whole") + (F.col("prior") + F.col("rank") <= F.col("quota")).cast("int")
    out = rows.withColumn("rank", rank).join(prior, ["key", "size", "bucket"]).join(F.broadcast(aim), "key").withColumn("passes", passes)
    return out.select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs with all their columns, each as often as the mix takes it. Rows, not ids, are ranked; columns may have any names."""
    keyed = _keyed(docs, seed, id, source, text)
    prior, aim = _quotas(stored(docs.select(*[c.alias(n) for n, c in keyed.items()]).drop("h")), weights, share)
    whole = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in keyed.items()])
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", F.col("row")[id]))
    met = whole.withColumn("rank", rank).join(prior, ["key", "size", "bucket"]).join(F.broadcast(aim), "key")
    passes = F.col("whole") + (F.col("prior") + F.col("rank") <= F.col("quota")).cast("int")
    return met.select("row", F.explode(F.array_repeat(F.lit(1), passes))).select("row.*")
