"""Leak-free splits by structure: exact dedup, protected signatures, structural hold-out, hash buckets, audit.

Plan: one shuffle by deck for the dedup (combined map-side). The signatures are written once, and who is protected and held out is found among
them: the examples are read a second time only for what is asked of them. Held-out signatures are at most HELD_OUT rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import written
from .ordering import fresh, ranked

#: Defaults: signatures held out, percent of buckets for test a and up to validation.
HELD_OUT, TEST_A, VAL = 8, 12, 5


def deduplicated(decks: DataFrame) -> DataFrame:
    """The first of each deck by seq: a combined minimum, not a window."""
    first = decks.groupBy("deck").agg(F.min("seq").alias("seq"))
    return decks.join(first, ["deck", "seq"], "left_semi") if len(decks.columns) > 2 else first.select("seq", "deck")


def signed(decks: DataFrame) -> DataFrame:
    """decks with sig, sig_fine and h; a deck is parsed once for both signatures."""
    kinds = fresh(decks, "kinds")[0]
    parsed = decks.withColumn(kinds, T.kinds("deck"))
    both = {"sig": F.array_join(F.array_sort(F.array_distinct(kinds)), ","), "sig_fine": F.array_join(kinds, ","), "h": T.bucket("deck")}
    return parsed.withColumns(both).drop(kinds)


def kind_spread(examples: DataFrame) -> DataFrame:
    """(kind, n_sigs, sig): in how many signatures a kind lives, and the least of them."""
    spread = examples.select("sig").distinct().select("sig", F.explode(T.kinds_in("sig")).alias("kind"))
    return spread.groupBy("kind").agg(F.count(F.lit(1)).alias("n_sigs"), F.min("sig").alias("sig"))


def protected(examples: DataFrame) -> DataFrame:
    """Signatures that alone have some kind."""
    return kind_spread(examples).where("n_sigs = 1").select("sig").distinct()


def held_out(examples: DataFrame, k: int = HELD_OUT) -> DataFrame:
    """The k signatures with the least hash (ties by signature), protected ones left out."""
    sigs = written(examples.select("sig").distinct())
    eligible = sigs.join(protected(sigs), "sig", "left_anti")
    return eligible.withColumn("sig_hash", T.hash32("sig")).orderBy("sig_hash", "sig").limit(k)


def assigned(examples: DataFrame, k: int = HELD_OUT, test_a: int = TEST_A, val: int = VAL) -> DataFrame:
    """examples with their split."""
    b = held_out(examples, k).select("sig", F.lit(True).alias("is_b"))
    split = F.when(F.col("is_b"), "test_b").when(F.col("h") < test_a, "test_a").when(F.col("h") < test_a + val, "val").otherwise("train")
    return examples.join(F.broadcast(b), "sig", "left").withColumn("split", split).drop("is_b")


def buckets(examples: DataFrame) -> DataFrame:
    """(sig, h, n): how many examples of a signature fall into a bucket, written once. It decides a split as the examples do."""
    return written(examples.groupBy("sig", "h").agg(F.count(F.lit(1)).alias("n")))


def counts(split: DataFrame) -> DataFrame:
    """(split, examples, signatures) of a split of examples, or of their buckets."""
    n = F.sum("n") if "n" in split.columns else F.count(F.lit(1))
    return split.groupBy("split").agg(n.alias("examples"), F.countDistinct("sig").alias("signatures"))


def audit(split: DataFrame) -> DataFrame:
    """One row: exact, coarse and fine leaks into train, kinds that train lost, and whether all are none.

    Rows are put together by deck, those by fine signature, those by signature, those by kind: each step has fewer."""
    part = lambda name: (F.col("split") == name).cast("long")
    seen = lambda c: F.max(c).alias(c)
    total = lambda c: F.sum(c).alias(c)
    decks = split.groupBy("deck", "sig_fine", "sig").agg(F.max(part("train")).alias("train"), F.sum(part("test_a")).alias("a"), F.sum(part("test_b")).alias("b"))
    fine = decks.groupBy("sig_fine", "sig").agg(seen("train"), total("b"), F.sum(F.col("train") * F.col("a")).alias("exact_a"), F.sum(F.col("train") * F.col("b")).alias("exact_b"))
    coarse = fine.groupBy("sig").agg(F.max("train").alias("t"), total("b"), total("exact_a"), total("exact_b"), F.sum(F.col("train") * F.col("b")).alias("fine_b"))
    coarse = coarse.select("sig", F.col("t").alias("train"), (F.col("b") > 0).cast("long").alias("b"), "exact_a", "exact_b", "fine_b")
    kinds = coarse.select(F.explode(T.kinds_in("sig")).alias("kind"), "train", "b").groupBy("kind").agg(seen("train"), seen("b"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = coarse.agg(zero("exact_a").alias("exact_a"), zero("exact_b").alias("exact_b"), zero(F.col("train") * F.col("b")).alias("coarse_b"), zero("fine_b").alias("fine_b"))
    lost = kinds.agg(zero(F.col("b") * (1 - F.col("train"))).alias("kinds_lost"))
    row = sums.crossJoin(F.broadcast(lost))  # two single rows
    return row.withColumn("clean", sum((F.col(n) for n in row.columns), F.lit(0)) == 0)


def ordered(split: DataFrame) -> DataFrame:
    """split with sig_rank, the place of a row's signature in its split's file: test_b by hash and signature, others by first appearance.

    Only signatures are ranked, by ranges of their order; rows of a signature follow by seq."""
    is_b = F.col("split") == "test_b"
    used = split.groupBy("split", "sig").agg(F.min("seq").alias("own"))
    first = used.groupBy("sig").agg(F.min("own").alias("first"))
    keyed = used.join(first, "sig").select("split", "sig", F.when(is_b, T.hash32("sig")).otherwise(F.col("first")).alias("a"), F.when(is_b, F.col("sig")).alias("b"))
    ranks = ranked(keyed, "split", ["a", "b"], "sig_rank").select("split", "sig", "sig_rank")
    return split.join(ranks, ["split", "sig"])


def tail_bearing(split: DataFrame, tail_kinds: list[str]) -> DataFrame:
    """Rows whose signature has one of these kinds."""
    return split.where(F.arrays_overlap(T.kinds_in("sig"), F.array(*[F.lit(k) for k in tail_kinds])))


def checked(split: DataFrame) -> DataFrame:
    """The audit's row; raises where it is not clean."""
    found = audit(split).first()
    if not found.clean:
        raise AssertionError(f"the split leaks: {found.asDict()}")
    return split
