"""Rare-kind metrics: document frequencies, head and tail, recall and precision of predicted decks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, wilson

CUT, FEWEST = 1000, 30


def document_frequency(kinds: DataFrame) -> DataFrame:
    """(kind, n) from rows with an array of distinct kinds."""
    return kinds.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def partitioned(frequency: DataFrame, cut: int = CUT) -> DataFrame:
    """frequency with part tail (below the cut) or head."""
    return frequency.withColumn("part", F.when(F.col("n") < cut, "tail").otherwise("head"))


def by_frequency(frequency: DataFrame) -> DataFrame:
    """frequency from the most to the least frequent, ties by kind."""
    return frequency.orderBy(F.desc("n"), "kind")


def registered(frequency: DataFrame, n_train, cut: int = CUT) -> DataFrame:
    """One row, the document that fixes the cut: cut, n_train, tail and head kinds by name, and freq, the most frequent first.

    It holds every kind once: a vocabulary, not the examples."""
    part = partitioned(frequency, cut)
    names = lambda p: F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("kind"))))
    freq = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind")))
    row = part.agg(names("tail").alias("tail"), names("head").alias("head"), freq.alias("f"))
    return row.select(F.lit(cut).alias("cut"), F.lit(n_train).cast("long").alias("n_train"), "tail", "head", F.transform("f", lambda x: F.struct(x["kind"].alias("kind"), (-x["n"]).alias("n"))).alias("freq"))


def hits(pairs: DataFrame) -> DataFrame:
    """(kind, gold, pred, hit) from rows of arrays gold and pred, in one pass."""
    spread = pairs.select(F.explode(F.array_union("gold", "pred")).alias("kind"), "gold", "pred")
    inside = lambda side: F.array_contains(side, F.col("kind")).cast("long")
    return spread.groupBy("kind").agg(F.sum(inside("gold")).alias("gold"), F.sum(inside("pred")).alias("pred"), F.sum(inside("gold") * inside("pred")).alias("hit"))


def recall(found: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, gold, hit, recall, low, high) over the kinds that parts knows."""
    out = found.join(parts.select("kind", "part"), "kind").groupBy("part").agg(F.sum("gold").alias("gold"), F.sum("hit").alias("hit"))
    low, high = wilson(F.col("hit"), F.col("gold"))
    return out.select("part", "gold", "hit", ratio(F.col("hit"), F.col("gold")).alias("recall"), low.alias("low"), high.alias("high"))


def report(found: DataFrame, parts: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """A row for each kind with gold, the tail first, then by gold: recall, precision, and whether gold is too small to tell."""
    rows = found.where("gold > 0").join(parts.select("kind", "part"), "kind", "left")
    g, p, h = F.col("gold"), F.col("pred"), F.col("hit")
    out = rows.select("kind", F.coalesce(F.col("part") == "tail", F.lit(False)).alias("is_tail"), "gold", "pred", "hit", ratio(h, g).alias("recall"), ratio(h, p).alias("precision"), (g < fewest).alias("few"))
    return out.orderBy(F.desc("is_tail"), F.desc("gold"), "kind")


def hallucinated(found: DataFrame) -> DataFrame:
    return found.where("gold = 0 and pred > 0").select("kind", "pred")
